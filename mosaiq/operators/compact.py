"""Many tiny files into few of good size, and which of them hold the same record."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.functions.paths import once, parse_parts, resolve_parts, run_parts, same_configuration, score_text
from mosaiq.operators.communities import connected
from mosaiq.session import Scratch, filesystem, new_path

SCORE_TOLERANCE = 1e-4


def checksum(df: DataFrame) -> dict:
    """Order-free checksum of the rows as a multiset: count, two 64-bit hash sums, an xor."""
    cols = [F.to_json(F.col(f"`{c}`")) if t.startswith("map") else F.col(f"`{c}`") for c, t in sorted(df.dtypes)]
    nulls = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in sorted(df.columns)])
    h1, h2 = F.xxhash64(*cols, nulls), F.xxhash64(F.lit("second"), nulls, *cols)
    big = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    return df.agg(F.count("*").alias("n"), big(h1).alias("s1"), big(h2).alias("s2"), F.bit_xor(h1).alias("x")).first().asDict()


def compact(df: DataFrame, out: str, target_bytes: int = 128 << 20) -> DataFrame:
    """Write all rows of ``df`` to few files of about ``target_bytes`` below ``out`` and return that table.

    The rows pass a REBALANCE exchange: adaptive execution merges small and splits large output partitions from
    their measured sizes, so one hot source can't make one huge file. The files are written to a staging folder,
    read back, and moved to ``out`` only if the multiset checksum of what was written equals that of what was
    read; otherwise the staging folder stays for inspection and an error is raised. ``out`` must not exist.
    An empty input gives an empty table. Nulls, repeated rows and any further columns are kept as they are.
    """
    spark = df.sparkSession
    fs, target = filesystem(spark, out)
    if fs.exists(target):
        raise FileExistsError(out)
    staging = f"{out}.staging-{uuid.uuid4().hex[:8]}"
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(target_bytes))
    try:
        df.hint("rebalance").write.parquet(staging)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    was, now = checksum(df), checksum(spark.read.schema(df.schema).parquet(staging))
    if was != now:
        raise RuntimeError(f"not committed: read {was}, wrote {now} in {staging}")
    if not fs.rename(filesystem(spark, staging)[1], target):
        raise RuntimeError(f"not committed: {staging} can't be moved to {out}")
    return spark.read.schema(df.schema).parquet(out)


def score_records(files: DataFrame) -> DataFrame:
    """Records of stored score files: (file_id, record_key, raw, normalized), one row per readable file row.

    ``record_key`` is made of the run's number, the configuration and the section, all taken from the path, as the
    section column is often wrong. Rows whose path or text is null, unreadable or of another layout are no records.
    """
    r = files.where("file_id is not null and file_path is not null and file_text is not null")
    r = once(r.select("file_id", "file_path", "file_text"), "s", score_text(F.col("file_text"))).where("s is not null")
    r = once(once(r, "parts", resolve_parts(F.col("file_path"))), "r", run_parts(F.col("parts"))).where("r.run is not null")
    r = once(r, "m", parse_parts(F.col("r.parts"))).where("m is not null")
    key = F.concat_ws("|", F.col("r.run").cast("string"), same_configuration(F.col("m")), F.col("m.section"))
    return r.select("file_id", key.alias("record_key"), "s.raw", "s.normalized")


def same_record_pairs(records: DataFrame, tol: float = SCORE_TOLERANCE) -> DataFrame:
    """Pairs (file_id_1, file_id_2) of files with equal key and scores that differ by less than ``tol``.

    A band join: scores are binned at ``tol``, one side also looks into the next bin. Normalized scores are
    compared only if both sides have one. A file stored twice is no pair with itself.
    """
    b = records.withColumn("bin", F.floor(F.col("raw") / tol)).dropDuplicates()
    left = b.select(F.col("file_id").alias("a"), "record_key", F.col("raw").alias("ra"), F.col("normalized").alias("na"), F.col("bin").alias("ba"), F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"))
    right = b.select(F.col("file_id").alias("b"), "record_key", F.col("raw").alias("rb"), F.col("normalized").alias("nb"), "bin")
    near = (F.abs(F.col("ra") - F.col("rb")) < tol) & F.coalesce(F.abs(F.col("na") - F.col("nb")) < tol, F.lit(True))
    once = (F.col("ba") < F.col("bin")) | (F.col("a") < F.col("b"))
    j = left.join(right, ["record_key", "bin"]).where(near & once & (F.col("a") != F.col("b")))
    return j.select(F.least("a", "b").alias("file_id_1"), F.greatest("a", "b").alias("file_id_2")).distinct()


def record_classes(records: DataFrame, tol: float = SCORE_TOLERANCE) -> DataFrame:
    """(file_id, record_key, record_id, n_files): each file with the record it holds.

    Within a key, files that same_record_pairs finds equal are one record, also through others between them, but a
    file without a normalized score never joins two records that have different ones: it counts to the one with the
    smallest id. Only distinct scores are compared, so no key's files are gathered. record_id is the smallest file_id
    of the class, among those with a normalized score if there are any.
    """
    s = Scratch(records.sparkSession, "classes")
    key = ["record_key", "raw", "normalized"]
    p = s.put(records.groupBy(*key).agg(F.min("file_id").alias("first")).withColumn("p", F.xxhash64(*key)).withColumn("bin", F.floor(F.col("raw") / tol)), "points")
    full, bare = p.where("normalized is not null"), p.where("normalized is null")
    other = full.select("record_key", F.col("raw").alias("raw_2"), F.col("normalized").alias("normalized_2"), F.col("p").alias("v"), "bin")
    near = lambda df: df.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))).join(other, ["record_key", "bin"]).where(F.abs(F.col("raw") - F.col("raw_2")) < tol)
    pairs = near(full).where((F.abs(F.col("normalized") - F.col("normalized_2")) < tol) & (F.col("p") < F.col("v"))).select(F.col("p").alias("u"), "v")
    root = full.join(connected(s, pairs).toDF("p", "root"), "p", "left").select("record_key", "p", "first", F.coalesce("root", "p").alias("root"))
    ids = root.groupBy("root").agg(F.min("first").alias("record_id"))
    root = s.put(root.join(ids, "root").select("p", "record_id"), "roots")

    # scores without a normalized one: chains of raw scores, each to the first record that it touches
    w = W.partitionBy("record_key").orderBy("raw")
    starts = F.coalesce((F.col("raw") - F.lag("raw").over(w) >= tol).cast("int"), F.lit(1))
    bare = bare.withColumn("starts", starts).withColumn("chain", F.sum("starts").over(w)).drop("starts")
    bare = s.put(bare, "chains")
    touched = near(bare).join(root.withColumnRenamed("p", "v"), "v").groupBy("record_key", "chain").agg(F.min("record_id").alias("record_id"))
    own = bare.groupBy("record_key", "chain").agg(F.min("first").alias("own")).join(touched, ["record_key", "chain"], "left").select("record_key", "chain", F.coalesce("record_id", "own").alias("record_id"))
    of = s.put(root.unionByName(bare.join(own, ["record_key", "chain"]).select("p", "record_id")), "classes")
    c = records.withColumn("p", F.xxhash64(*key)).join(of, "p").select("file_id", "record_key", "record_id").distinct()
    n = c.groupBy("record_key", "record_id").agg(F.countDistinct("file_id").alias("n_files"))
    return c.join(n, ["record_key", "record_id"]).select("file_id", "record_key", "record_id", "n_files")


def kept_files(spark: SparkSession, files: DataFrame, target_bytes: int = 128 << 20, out: str | None = None) -> DataFrame:
    """One row of each record's kept file, with all columns, as a compacted table, written as ``compact`` does.

    The kept file is that whose file_id is the record_id. Of repeated rows of it the latest modified counts.
    """
    rows = Scratch(spark, "kept").put(files, "files")
    r = Scratch(spark, "kept").put(score_records(rows), "records")
    keep = record_classes(r).where("file_id = record_id").select("file_id").distinct()
    order = [F.desc("modified_at")] if "modified_at" in files.columns else []
    w = W.partitionBy("file_id").orderBy(*order, "file_path", "file_text")
    kept = rows.where("file_path is not null and file_text is not null").join(keep, "file_id", "left_semi")
    kept = Scratch(spark, "kept").put(kept.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"), "kept")
    if kept.count() != keep.count():
        raise RuntimeError("not every record has its kept file")
    return compact(kept, out or new_path(spark, "kept"), target_bytes)


def compact_score_files(spark: SparkSession, files: DataFrame, target_bytes: int = 128 << 20, out: str | None = None) -> DataFrame:
    """All rows and columns of the tiny files as one compacted table."""
    return compact(files, out or new_path(spark, "compact"), target_bytes)
