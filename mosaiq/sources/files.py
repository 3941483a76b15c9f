"""Score files, logs, job lists and CSV features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import paths


def read_score_files(spark: SparkSession, folder: str, pattern: str = "*.score") -> DataFrame:
    """(file_path, file_text) of all matching files below a folder, as compaction and aggregation take them."""
    d = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    return d.select(F.input_file_name().alias("file_path"), F.col("value").alias("file_text"))


def aggregate_score_files(files: DataFrame, base: str) -> DataFrame:
    """Readable score files as a table: older flat metadata of the path below ``base`` and both scores."""
    f = paths.once(files.where("file_path is not null and file_text is not null"), "s", paths.score_text(F.col("file_text"))).where("s is not null")
    f = paths.once(f, "m", paths.parse_path(F.col("file_path"), base)).where("m is not null")
    return f.select(*paths.legacy_columns(F.col("m")), "file_path", F.col("s.raw").alias("percolation_score"), F.col("s.normalized").alias("normalized_percolation_score"))


def combine_texts(files: DataFrame, out: str) -> None:
    """Contents of all files that aren't empty, as text files of a line per file."""
    files.select(F.trim("file_text").alias("value")).where("value <> ''").write.text(out)


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text) of each log file."""
    return read_score_files(spark, folder, "*.log").toDF("id", "text")


def read_job_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a job list, trimmed, without blank lines and those that begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("job")).where("job <> '' and not startswith(job, '#')")


def write_job_list(jobs: DataFrame, out: str) -> None:
    jobs.select(F.concat_ws("\t", *jobs.columns).alias("value")).write.text(out)


def read_csv_features(spark: SparkSession, path: str, section_column: str | None = None) -> DataFrame:
    """(section, features) from a CSV file with header: the first (or named) column is the section, numeric ones the rest."""
    d = spark.read.csv(path, header=True, inferSchema=True)
    sec = section_column or d.columns[0]
    nums = [c for c, t in d.dtypes if c != sec and t in ("int", "bigint", "double", "float")]
    return d.select(F.col(f"`{sec}`").cast("string").alias("section"), F.array(*[F.col(f"`{c}`").cast("double") for c in nums]).alias("features"))


def pending_files(inputs: DataFrame, outputs: DataFrame, in_ext: str, out_ext: str) -> DataFrame:
    """Inputs (column path) without an output of the same relative name."""
    stem = lambda ext: F.regexp_replace("path", rf"\{ext}$", "")
    return inputs.withColumn("_stem", stem(in_ext)).join(outputs.select(stem(out_ext).alias("_stem")).distinct(), "_stem", "left_anti").drop("_stem")


def write_environment_csv(wide: DataFrame, out: str) -> None:
    wide.write.option("header", "true").csv(out)


def write_curves(curves: DataFrame, out: str) -> None:
    """Entropy curves (section, variant, step, pbond, entropy, n), by section, so that one can be read alone."""
    curves.repartition("section").write.partitionBy("section").parquet(out)


def rescore(spark: SparkSession, path: str, sections: list[str] | None = None) -> DataFrame:
    """(section, n, raw, normalized) anew from stored curves. Sections that lack one variant or any step have no score."""
    from mosaiq.operators.percolation import percolation_score

    c = spark.read.schema("variant byte, step int, pbond double, entropy double, n long, section string").parquet(path)
    c = c.where(F.col("section").isin(sections)) if sections else c
    ok = F.col("entropy").isNotNull() & (F.abs("entropy") < float("inf"))
    whole = c.groupBy("section").agg(F.countDistinct(F.when(ok & (F.col("variant") == 0), F.col("step"))).alias("a"), F.countDistinct(F.when(ok & (F.col("variant") == 1), F.col("step"))).alias("b"), F.max("step").alias("last"))
    c = c.join(whole.where("a = last and b = last").select("section"), "section", "left_semi")
    return percolation_score(c.where("variant = 0"), c.where("variant = 1"))


def write_snapshot(configs: DataFrame, order: list[str], out: str) -> None:
    """Configurations as CSV with header, numbered by _row_idx (from 0) in the given, unique order."""
    from mosaiq.operators.results import in_order

    in_order(configs, order).withColumnRenamed("place", "_row_idx").write.option("header", "true").csv(out)
