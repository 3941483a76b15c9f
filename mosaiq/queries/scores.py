"""Queries over scores, labelings, paths and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import grids, paths
from mosaiq.operators import features, logs, percolation, results
from mosaiq.session import table

_KEYS = ", ".join(results.CONFIG)


def _r(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


def section_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return results.section_cells(table(spark, d, "cells"))


def sections_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cells").where("section is not null").select("section").distinct()


def reduce_scores_weighted(spark: SparkSession, d: str) -> DataFrame:
    r = results.reduce_scores(table(spark, d, "scores"), results.section_cells(table(spark, d, "cells")))
    for c in r.columns:
        if "score_" in c:
            r = r.withColumn(c, F.round(c, 7 if c.endswith("std") else 10))
    return r


def best_configuration(spark: SparkSession, d: str) -> DataFrame:
    """The configuration with the largest weighted mean score."""
    r = results.reduce_scores(table(spark, d, "scores"), results.section_cells(table(spark, d, "cells")))
    top = r.orderBy(F.desc("raw_score_weighted_mean"), *[F.asc_nulls_first(c) for c in results.CONFIG]).limit(1)
    return _r(top.select(*results.CONFIG, "raw_score_weighted_mean"), "raw_score_weighted_mean")


def scores_summary(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(~F.isnan("percolation_score"), F.col("percolation_score"))
    g = table(spark, d, "scores").groupBy("method").agg(F.count("*").alias("n"), F.count(s).alias("valid"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean"))
    return _r(g.withColumn("missing", F.col("n") - F.col("valid")), "mean")


def trapz_score(spark: SparkSession, d: str) -> DataFrame:
    """Integral of the mean score over log10 resolution, per method, data type and distance."""
    s = table(spark, d, "scores").where("resolution > 0 and percolation_score is not null and not isnan(percolation_score)")
    k = ["method", "data_type", "distance"]
    c = s.groupBy(*k, "resolution").agg(F.avg("percolation_score").alias("y")).withColumn("x", F.log10("resolution"))
    return _r(percolation.trapezoid(c, k, "x", "y", "integral"), "integral")


def normalized_score(spark: SparkSession, d: str) -> DataFrame:
    """Raw score over log2 of the section's number of cells."""
    s = table(spark, d, "scores").select("file_path", "section_name", "percolation_score", "scored_at").where("percolation_score is not null")
    j = s.join(results.section_cells(table(spark, d, "cells")).withColumnRenamed("section", "section_name"), "section_name").where("n_cells > 1")
    return _r(j.select("file_path", "scored_at", (F.col("percolation_score") / F.log2("n_cells")).alias("normalized")), "normalized")


def pooled_type_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _r(results.pooled_type_stats(table(spark, d, "cluster_labels")), "type_distribution_entropy")


def contingency_table(spark: SparkSession, d: str) -> DataFrame:
    return results.contingency(results.distinct_labels(table(spark, d, "cluster_labels")))


def ari_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _r(results.adjusted_rand(contingency_table(spark, d)), "ari")


def ari_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index of all pairs of annotation levels of the cells."""
    return _r(results.adjusted_rand(results.contingency(features.encoded(table(spark, d, "cells")))), "ari")


def comparison_pairs(spark: SparkSession, d: str) -> DataFrame:
    return results.pairs_of(table(spark, d, "cluster_labels").where("config_id is not null").select("config_id").distinct(), "config_id")


def n_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Number of pairs and of chunks of 10 pairs."""
    n = table(spark, d, "cluster_labels").agg(F.countDistinct("config_id").alias("n"))
    p = n.select("n", (F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs"))
    return p.withColumn("chunks", F.ceil(F.col("pairs") / 10))


def section_intersection(spark: SparkSession, d: str) -> DataFrame:
    """Sections that two labelings share, per pair."""
    s = table(spark, d, "cluster_labels").where("section is not null").select("config_id", "section").distinct()
    a, b = s.toDF("config_1", "section"), s.toDF("config_2", "section")
    return a.join(b, "section").where("config_1 < config_2").select("config_1", "config_2", "section")


def union_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Scores by method as chunks, one of which lacks the normalized score, back in one table."""
    s = table(spark, d, "scores").select("method", "section_name", "file_path", "percolation_score", "normalized_percolation_score")
    lda = s.where("method = 'Lda'").drop("normalized_percolation_score")
    return results.union_chunks(("file_path", "percolation_score"), s.where("method <> 'Lda'"), lda)


def score_layout_parse(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "score_files").select("file_id", "file_text").where("file_text is not null")
    f = paths.once(f, "s", paths.score_text(F.col("file_text"))).where("s is not null")
    return f.select("file_id", F.round("s.raw", 6).alias("raw"), F.round("s.normalized", 6).alias("normalized"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "score_files").select("file_id", "file_path").where("file_path is not null")
    f = paths.once(paths.once(f, "parts", paths.resolve_parts(F.col("file_path"))), "r", paths.run_parts(F.col("parts")))
    return paths.once(f, "m", paths.parse_parts(F.col("r.parts"))).where("m is not null")


def parse_path(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("file_id", "r.run", "m.*")


def resolved_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Resolution of each result path, an index being taken for its grid value."""
    m = F.col("m")
    v = F.coalesce(m["resolution"], F.when(m["resolution_idx"].between(0, 49), paths.grid_value(m["resolution_idx"])))
    return _parsed(spark, d).where(v.isNotNull()).select("file_id", F.round(v, 3).alias("resolution"))


def build_path(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("file_id", paths.build_path(F.col("m")).alias("rel_path"))


def legacy_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).select("file_id", *paths.legacy_columns(F.col("m")))


def aggregate_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score files to one table: old-style metadata of the path and both scores, unreadable files left out."""
    f = table(spark, d, "score_files").select("file_id", "file_text").where("file_text is not null")
    f = paths.once(f, "s", paths.score_text(F.col("file_text"))).where("s is not null").select("file_id", F.col("s.raw").alias("percolation_score"), F.col("s.normalized").alias("normalized_percolation_score")).distinct()
    return _r(legacy_metadata(spark, d).distinct().join(f, "file_id"), "percolation_score", "normalized_percolation_score")


def resolution_dirname(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "scores").where("resolution is not null").select("resolution").distinct()
    return r.select("resolution", grids.resolution_dirname(F.col("resolution")).alias("dirname"))


def resolution_grid(spark: SparkSession, d: str) -> DataFrame:
    """Grid values that the scores use, with their number of scores."""
    g = spark.range(50).select("id", F.round(paths.grid_value(F.col("id")), 3).alias("value"))
    s = table(spark, d, "scores").where("resolution is not null").select(F.round("resolution", 3).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    return g.join(s, "value").select("id", "value", "n")


def k_grid(spark: SparkSession, d: str) -> DataFrame:
    """Values of the k grid that the scores use as clustering_k."""
    g = spark.createDataFrame([(k,) for k in grids.k_values(9, 10, 1000)], "k long")
    s = table(spark, d, "scores").select(F.col("clustering_k").cast("bigint").alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    return g.join(s, "k")


def folder_name(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scores").select("method", "data_type", "distance", "env_k", "weighted").distinct()
    return s.withColumn("folder", grids.folder_name(*[F.col(c) for c in ("method", "data_type", "distance", "env_k", "weighted")]))


def derived_name(spark: SparkSession, d: str) -> DataFrame:
    """Names of features derived by PCA from the local-frequency features that the scores' settings make."""
    s = table(spark, d, "scores").where("env_k is not null").select(F.concat(F.lit("localfreq"), F.when(F.col("weighted"), "_w").otherwise(""), F.lit("_k"), F.col("env_k").cast("bigint").cast("string")).alias("source")).distinct()
    s = s.withColumn("n", F.explode(F.array(F.lit(15), F.lit(50))))
    return s.withColumn("derived", grids.derived_name(F.col("source"), F.lit("pca"), F.col("n")))


def wildcard_features(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "scores").select("algorithm").distinct()
    return a.where(grids.glob_match(F.col("algorithm"), "Leiden*Co*") | grids.glob_match(F.col("algorithm"), "Kmeans_pca??_env_k_*"))


def expected_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Every configuration of the scores for every section: (step, rel_path)."""
    c = table(spark, d, "scores").where("file_path is not null").select(F.regexp_extract("file_path", r"^run_\d+/(.*)/[^/]*$", 1).alias("config")).where("config <> ''").distinct()
    return c.crossJoin(table(spark, d, "sections").select("section").distinct()).select(F.lit("percolation").alias("step"), F.concat_ws("/", "config", F.concat("section", F.lit(".score"))).alias("rel_path"))


def _existing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scores").where("percolation_score is not null").select(F.lit("percolation").alias("step"), F.regexp_replace("file_path", r"^run_\d+/", "").alias("rel_path"))


def progress_report(spark: SparkSession, d: str) -> DataFrame:
    return _r(results.progress(expected_outputs(spark, d), _existing(spark, d)), "percent")


def pending_jobs(spark: SparkSession, d: str) -> DataFrame:
    return results.pending(expected_outputs(spark, d), _existing(spark, d), ["step", "rel_path"])


def completed_semi(spark: SparkSession, d: str) -> DataFrame:
    """Configurations whose outputs exist for all sections that the run's outputs cover."""
    e = _existing(spark, d).distinct().select(F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1).alias("config"), F.regexp_extract("rel_path", r"([^/]*)$", 1).alias("name"))
    n = e.agg(F.countDistinct("name").alias("n"))
    return e.groupBy("config").agg(F.countDistinct("name").alias("have")).crossJoin(F.broadcast(n)).where("have = n").select("config", "have")  # one row


def chunk_assign(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous chunks of 500 score files in order of file id."""
    f = table(spark, d, "score_files").where("file_id is not null").select("file_id").distinct()
    return results.chunks(f, ["file_id"], 500).groupBy("chunk").agg(F.count("*").alias("n"), F.min("file_id").alias("first"), F.max("file_id").alias("last"))


def calibration_sample(spark: SparkSession, d: str) -> DataFrame:
    """Ten files at equal strides, a sample by which run times are calibrated."""
    f = table(spark, d, "score_files").where("file_id is not null").select("file_id").distinct()
    n = max(1, f.count() // 10)
    c = results.chunks(f, ["file_id"], n)
    return c.where("chunk <= 10").groupBy("chunk").agg(F.min("file_id").alias("file_id")).select("file_id")


def _logs(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, modified, file_id, path) of logs as the workers that wrote the score files would leave them: one per file."""
    f = table(spark, d, "score_files").where("file_id is not null").groupBy("file_id").agg(*[F.min(c).alias(c) for c in ("file_path", "file_text", "section", "n_bytes", "modified_at")])
    at = lambda c: F.date_format(c, "EEE MMM d HH:mm:ss 'UTC' yyyy")
    body = F.when(F.col("file_text").isNull(), F.concat(F.lit("  Skipping missing file: "), "file_path", F.lit("\n"))).when(paths.score_text(F.col("file_text")).isNull(), F.concat(F.lit("Traceback: "), "file_text", F.lit("\n"))).otherwise("")
    end = F.when(F.col("section").isNotNull(), F.concat(F.lit("End time: "), at(F.col("modified_at") + F.make_dt_interval(secs=F.coalesce("n_bytes", F.lit(0)))), F.lit("\nDone SGE_TASK_ID "), F.col("file_id").cast("string"), F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("Processing chunk: chunk_0001_of_0001.txt\nStart time: "), at("modified_at"), F.lit("\nProcessing 2 percolation jobs from chunk\n"), body, end)
    job = F.coalesce(F.nullif(F.regexp_extract("file_path", r"run_(\d+)", 1), F.lit("")), F.lit("0"))
    return f.select(F.concat(F.lit("percolation."), job, F.lit("."), F.col("file_id").cast("string"), F.lit(".log")).alias("id"), text.alias("text"), F.col("modified_at").alias("modified"), "file_id", F.col("file_path").alias("path"), paths.score_text(F.col("file_text")).isNull().alias("lacks"))


def log_classify(spark: SparkSession, d: str) -> DataFrame:
    return logs.classify(_logs(spark, d)).select("id", "has_error", "has_warning", "abnormal_end", F.size("lines").alias("n_lines"), F.get("lines", F.lit(0)).alias("first_line"))


def log_parse(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse(_logs(spark, d)).select("id", "job_id", "task_id", "n_tasks", "done", F.col("seconds").alias("seconds"))


def log_durations(spark: SparkSession, d: str) -> DataFrame:
    """Durations of the logs of each job."""
    return _r(logs.durations(logs.parse(_logs(spark, d)), ["job_id"]), "mean_s", "least_s", "most_s", "per_task_s")


def log_run_errors(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 suspicious logs, with the outputs of their tasks that are missing."""
    t = _logs(spark, d)
    found = logs.classify(t).join(logs.parse(t).select("id", "task_id"), "id").withColumn("step", F.lit("percolation"))
    jobs = t.where("path is not null").select(F.lit("percolation").alias("step"), F.col("file_id").alias("task_id"), F.concat("path", F.lit("\tout\tedges\t100")).alias("job_line"))
    out = logs.job_outputs(jobs, table(spark, d, "sections"))
    missing = t.where("lacks and path is not null").select(F.lit("percolation").alias("step"), F.col("path").alias("rel_path"))
    return logs.run_errors(found, out, missing).select("id", "task_id", "n_missing", F.get("missing", F.lit(0)).alias("first_missing"), F.get("jobs", F.lit(0)).alias("first_job"))


def file_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Times between successive score files of a section: number, mean, least and most seconds."""
    return _r(logs.gaps(table(spark, d, "score_files").where("section is not null"), "section", "modified_at", "file_id"), "mean_s", "least_s", "most_s")


def file_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cells per label in each file of labels, of which there is one per configuration and section."""
    n = results.distinct_labels(table(spark, d, "cluster_labels")).groupBy("config_id", "section", "label").agg(F.count("*").alias("n"))
    return n.select(F.concat_ws("/", "config_id", F.concat("section", F.lit(".npy"))).alias("file_path"), "label", "n")


def step_summary(spark: SparkSession, d: str) -> DataFrame:
    """Expected outputs per method, and the jobs they make if a job does all sections."""
    e = expected_outputs(spark, d).withColumn("method", F.regexp_extract("rel_path", "^([A-Z][a-z]+)", 1))
    n = table(spark, d, "sections").select("section").distinct().count()
    return e.groupBy("method").agg(F.count("*").alias("outputs")).withColumn("jobs", F.floor(F.col("outputs") / max(n, 1)))


def scores_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The score table in its order: place, path and score by algorithm, env_k, clustering_k and section, nulls last."""
    s = table(spark, d, "scores").select("algorithm", "env_k", "clustering_k", "section_name", "file_path", "percolation_score", "scored_at")
    by = ["algorithm", "env_k", "clustering_k", "section_name", "file_path", "percolation_score", "scored_at"]
    return results.in_order(s.groupBy(*by).agg(F.count("*").alias("n")), by).select("place", "file_path", "percolation_score", "n")


def encode_annotations(spark: SparkSession, d: str) -> DataFrame:
    return features.encode_annotations(table(spark, d, "cells"))


def annotation_summary(spark: SparkSession, d: str) -> DataFrame:
    e = features.encode_annotations(table(spark, d, "cells"))
    return e.groupBy("level").agg(F.countDistinct(F.when(F.col("code") >= 0, F.col("code"))).alias("n_types"), F.count("*").alias("n_cells"), F.count_if(F.col("code") < 0).alias("n_missing"))


def subsample_sections(spark: SparkSession, d: str) -> DataFrame:
    return features.subsample(table(spark, d, "cells"), 3, 50)


_SECTION_CELLS = "sc as (select section, count(distinct cell_id) n_cells from cells where section is not null group by section)"


def _wstat(col: str, name: str) -> str:
    v = f"case when not isnan({col}) then {col} end"
    w = f"case when {v} is not null then n_cells::double end"
    m = f"sum({w} * {v}) / sum({w})"
    return f"round({m}, 10) {name}_weighted_mean, round(sqrt(greatest(sum({w} * {v} * {v}) / sum({w}) - ({m}) * ({m}), 0)), 7) {name}_weighted_std, round(avg({v}), 10) {name}_unweighted_mean, round(stddev_pop({v}), 7) {name}_unweighted_std"


_REDUCE = f"""with {_SECTION_CELLS} select {_KEYS}, {_wstat("percolation_score", "raw_score")}, {_wstat("normalized_percolation_score", "normalized_score")},
  sum(n_cells)::bigint total_cells, count(*) n_sections, min(n_cells) min_cells_per_section, max(n_cells) max_cells_per_section
  from scores join sc on section_name = section group by {_KEYS}"""

_LABELS = "l as (select config_id, section, cell_id, min(label) label from cluster_labels where label >= 0 and config_id is not null and section is not null and cell_id is not null group by all)"
_CONT = "ct as (select x.config_id config_1, y.config_id config_2, x.label a, y.label b, count(*) n from l x join l y using (section, cell_id) where x.config_id < y.config_id group by all)"
_ARI = """,
 i as (select config_1, config_2, sum(n * (n - 1) / 2.0) i, sum(n)::bigint n_cells from ct group by all),
 sa as (select config_1, config_2, sum(m * (m - 1) / 2.0) sa, count(*) n_labels_1 from (select config_1, config_2, a, sum(n) m from ct group by all) group by all),
 sb as (select config_1, config_2, sum(m * (m - 1) / 2.0) sb, count(*) n_labels_2 from (select config_1, config_2, b, sum(n) m from ct group by all) group by all)
 select config_1, config_2, round(case when i = sa and i = sb then 1.0 else (i - sa * sb / t) / ((sa + sb) / 2.0 - sa * sb / t) end, 6) ari, n_cells, n_labels_1, n_labels_2
 from (select *, n_cells * (n_cells - 1) / 2.0 t from i join sa using (config_1, config_2) join sb using (config_1, config_2))"""
_LATEST = """lt as (select cell_id, r.section section, r.class class, r.subclass subclass, r.supertype supertype, r.c "cluster" from (
 select cell_id, arg_max(struct_pack(section := section, class := class, subclass := subclass, supertype := supertype, c := "cluster"),
   (exported_at, section, class, subclass, supertype, "cluster")) r from cells group by cell_id))"""
_CODES = _LATEST + """, lg as (select cell_id, section, 'class' as "level", class as v from lt union all select cell_id, section, 'subclass', subclass from lt
   union all select cell_id, section, 'supertype', supertype from lt union all select cell_id, section, 'cluster', "cluster" from lt),
 cd as (select "level", v, row_number() over (partition by "level" order by v) - 1 code from (select distinct "level", v from lg where v is not null)),
 codes as (select cell_id, section, lg."level", coalesce(code, -1)::int code from lg left join cd on cd."level" = lg."level" and cd.v = lg.v)"""
_SCORE = r"""sx as (select file_id, string_split(trim(file_text, e' \t\r\n'), e'\t') f from score_files where file_text is not null),
 sy as (select file_id, case when len(f) = 4 then trim(f[4]) when len(f) in (1, 2) then trim(f[1]) end a, case when len(f) = 2 then trim(f[2]) end b, len(f) n from sx),
 sz as (select file_id, case when regexp_full_match(a, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then a::double end raw, case when regexp_full_match(b, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then b::double end normalized, n from sy),
 score as (select file_id, raw, normalized from sz where raw is not null and (n <> 2 or normalized is not null))"""
_PARSED = r"""pn as (select file_id, regexp_replace(regexp_replace(file_path, '[^/.]+/\.\./', '', 'g'), '//+', '/', 'g') p from score_files where file_path is not null),
 pr as (select file_id, regexp_extract(p, 'run_(\d+)/', 1)::bigint run, regexp_extract(p, 'run_\d+/(.*)$', 1) rel from (select file_id, regexp_replace(regexp_replace(p, '/\./', '/', 'g'), '//+', '/', 'g') p from pn)),
 pp as (select *, string_split(rel, '/') s, string_split(rel, '/')[1] algo, regexp_extract(string_split(rel, '/')[-1], '^(.+?\.\d{2})(\.[^/]*)?$', 1) section from pr),
 pm as (select file_id, run, algo algorithm_string, section,
   case when starts_with(algo, 'Leiden') then 'leiden' when starts_with(algo, 'PhenoGraph') then 'phenograph' when lower(algo) like 'kmeans%' then 'kmeans' when starts_with(algo, 'LDA') then 'lda' else 'preexisting' end "method",
   case when algo like '%\_envenv%' escape '\' or lower(algo) like 'kmeans%' or algo like 'LDA%' then 'env' else 'celltype' end feature_type,
   case when algo like 'LDA%' then 'raw' when lower(algo) like 'kmeans%' then coalesce(nullif(regexp_extract(lower(algo), 'pca(15|50)'), ''), 'raw')
        else nullif(lower(regexp_extract(algo, '^(Leiden|PhenoGraph)(Raw|PCA15|PCA50|SCVI|Log1p)', 2)), '') end data_type,
   nullif(lower(regexp_extract(algo, '^(Leiden|PhenoGraph)(Raw|PCA15|PCA50|SCVI|Log1p)(Correlation|Euclidean|Cosine)', 3)), '') distance,
   case when algo like 'LDA%' then nullif(regexp_extract(s[2], '^k_(\d+)$', 1), '')::bigint when algo like '%\_k\_%' escape '\' then regexp_extract(algo, '_k_(\d+)', 1)::bigint end env_k,
   algo like '%\_envenv%' escape '\' and algo like '%\_w\_%' escape '\' weighted,
   case when starts_with(algo, 'Leiden') or starts_with(algo, 'PhenoGraph') then coalesce(nullif(regexp_extract(algo, '_res_(\d+)', 1), '')::bigint, nullif(regexp_extract(s[2], '^res_(\d+)$', 1), '')::bigint) end resolution_idx,
   case when (starts_with(algo, 'Leiden') or starts_with(algo, 'PhenoGraph')) and s[2] like 'res\_%p%' escape '\' then replace(replace(s[2], 'res_', ''), 'p', '.')::double end resolution,
   case when algo like 'LDA%' then nullif(regexp_extract(s[3], '^k_(\d+)$', 1), '')::bigint when lower(algo) like 'kmeans%' then nullif(regexp_extract(s[2], '^k_(\d+)$', 1), '')::bigint end clustering_k,
   case when regexp_matches(algo, '^(Preexisting|Allen)_') then regexp_replace(algo, '^(Preexisting|Allen)_', '') end annotation_level from pp)"""
_LEGACY = """select file_id, algorithm_string algorithm, case when "method" = 'preexisting' then 'Preexisting_' || annotation_level else upper("method"[1]) || "method"[2:] end "method",
  upper(data_type) data_type, upper(distance[1]) || distance[2:] distance, case when feature_type = 'env' then 'envenv' end env_type, weighted,
  nullif(env_k, 0)::varchar algorithm_k, nullif(env_k, 0)::varchar env_k, coalesce(nullif(clustering_k, 0), resolution_idx)::varchar clustering_k, resolution, section section_name from pm"""
_CAP = "upper({0}[1]) || lower({0}[2:])"
_TOKEN = f"case when lower(data_type) = 'scvi' then 'SCVI' when lower(data_type) like 'pca%' then upper(data_type) when lower(data_type) like 'localfreq%' then array_to_string(list_transform(string_split(lower(data_type), '_'), lambda p: upper(p[1]) || p[2:]), '') else {_CAP.format('data_type')} end"
_FOLDER = f"""case lower("method") when 'leiden' then 'Leiden' || coalesce({_TOKEN}, '') || coalesce({_CAP.format('distance')}, '') || case when env_k is not null then '_envenv' || case when weighted then '_w' else '' end || '_k_' || env_k::bigint else '' end
 when 'phenograph' then 'PhenoGraph' || coalesce({_TOKEN}, '') || coalesce({_CAP.format('distance')}, '')
 when 'kmeans' then 'Kmeans' || case when data_type is not null and lower(data_type) <> 'raw' then '_' || lower(data_type) else '' end || case when env_k is not null then '_env_k_' || env_k::bigint else '' end
 when 'lda' then 'LDA' else "method" end"""
_BAD = logs.any_of(logs.ERRORS + logs.WARNINGS)
_LOGS = r"""lf as (select file_id, min(file_path) file_path, min(file_text) file_text, min(section) section, min(n_bytes) n_bytes, min(modified_at) modified_at from score_files where file_id is not null group by file_id),
 ln as (select file_id, string_split(trim(file_text, e' \t\r\n'), e'\t') f from lf),
 lq as (select file_id, case when len(f) = 4 then trim(f[4]) when len(f) in (1, 2) then trim(f[1]) end a, case when len(f) = 2 then trim(f[2]) else '0' end b from ln),
 lk as (select lf.*, not coalesce(regexp_full_match(a, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') and regexp_full_match(b, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'), false) lacks, coalesce(nullif(regexp_extract(file_path, 'run_(\d+)', 1), ''), '0') job from lf join lq using (file_id)),
 lg as (select *, 'percolation.' || job || '.' || file_id || '.log' id, e'Processing chunk: chunk_0001_of_0001.txt\nStart time: ' || strftime(modified_at, '%a %b %-d %H:%M:%S UTC %Y') || e'\nProcessing 2 percolation jobs from chunk\n'
   || case when file_text is null then '  Skipping missing file: ' || file_path || e'\n' when lacks then 'Traceback: ' || file_text || e'\n' else '' end
   || case when section is not null then e'End time: x\nDone SGE_TASK_ID ' || file_id || e'\n' else '' end as "text" from lk)"""
_EXPECTED = r"""cf as (select distinct regexp_extract(file_path, '^run_\d+/(.*)/[^/]*$', 1) config from scores where file_path is not null),
 ex as (select 'percolation' step, config || '/' || section || '.score' rel_path from (select config from cf where config <> ''), (select distinct section from sections)),
 hv as (select distinct regexp_replace(file_path, '^run_\d+/', '') rel_path from scores where percolation_score is not null)"""

QUERIES = {
    f.__name__: f
    for f in (section_cell_counts, sections_distinct, reduce_scores_weighted, best_configuration, scores_summary, trapz_score, normalized_score, pooled_type_entropy, contingency_table, ari_all_pairs, ari_annotations, comparison_pairs, n_pairs, section_intersection, union_chunks, score_layout_parse, parse_path, resolved_resolution, build_path, legacy_metadata, aggregate_scores, resolution_dirname, resolution_grid, k_grid, folder_name, derived_name, wildcard_features, expected_outputs, progress_report, pending_jobs, completed_semi, chunk_assign, calibration_sample, log_classify, log_parse, log_durations, log_run_errors, file_gaps, file_type_counts, step_summary, scores_sorted, encode_annotations, annotation_summary, subsample_sections)
}

SQL = {
    "section_cell_counts": f"with {_SECTION_CELLS} select * from sc",
    "sections_distinct": "select distinct section from cells where section is not null",
    "reduce_scores_weighted": _REDUCE,
    "best_configuration": f"select {_KEYS}, round(raw_score_weighted_mean, 6) raw_score_weighted_mean from ({_REDUCE}) order by raw_score_weighted_mean desc nulls last, {', '.join(k + ' nulls first' for k in results.CONFIG)} limit 1",
    "scores_summary": "select method, count(*) n, count(s) valid, min(s) least, max(s) most, round(avg(s), 6) mean, count(*) - count(s) missing from (select method, case when not isnan(percolation_score) then percolation_score end s from scores) group by method",
    "trapz_score": """with c as (select method, data_type, distance, log10(resolution) x, avg(percolation_score) y from scores where resolution > 0 and percolation_score is not null and not isnan(percolation_score) group by method, data_type, distance, resolution),
        t as (select *, lead(x) over w nx, lead(y) over w ny from c window w as (partition by method, data_type, distance order by x))
        select method, data_type, distance, round(coalesce(sum((nx - x) * (ny + y) / 2.0), 0), 6) integral from t group by method, data_type, distance""",
    "normalized_score": f"with {_SECTION_CELLS} select file_path, scored_at, round(percolation_score / log2(n_cells), 6) normalized from scores join sc on section_name = section where percolation_score is not null and n_cells > 1",
    "pooled_type_entropy": """with n as (select config_id, label, count(*) n from (select distinct config_id, section, cell_id, label from cluster_labels where label >= 0) group by all)
        select config_id, count(*) total_number_of_types, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) type_distribution_entropy from n group by config_id""",
    "contingency_table": f"with {_LABELS}, {_CONT} select * from ct",
    "ari_all_pairs": f"with {_LABELS}, {_CONT} {_ARI}",
    "ari_annotations": f"with {_CODES}, l as (select \"level\" config_id, section, cell_id, code label from codes where code >= 0 and section is not null), {_CONT} {_ARI}",
    "comparison_pairs": """with c as (select config_id, row_number() over (order by config_id) - 1 idx from (select distinct config_id from cluster_labels where config_id is not null))
        select a.idx idx_1, a.config_id config_id_1, b.idx idx_2, b.config_id config_id_2 from c a join c b on a.idx < b.idx""",
    "n_pairs": "select n, n * (n - 1) // 2 pairs, ceil(n * (n - 1) / 2 / 10)::bigint chunks from (select count(distinct config_id) n from cluster_labels)",
    "section_intersection": "with s as (select distinct config_id, section from cluster_labels where section is not null) select a.config_id config_1, b.config_id config_2, section from s a join s b using (section) where a.config_id < b.config_id",
    "union_chunks": "select method, section_name, file_path, percolation_score, case when method <> 'Lda' then normalized_percolation_score end normalized_percolation_score from scores where method is not null",
    "score_layout_parse": f"with {_SCORE} select file_id, round(raw, 6) raw, round(normalized, 6) normalized from score",
    "parse_path": f"with {_PARSED} select * from pm",
    "resolved_resolution": f"with {_PARSED} select file_id, round(coalesce(resolution, pow(10, -1 + 3.5 * resolution_idx / 49)), 3) resolution from pm where resolution is not null or resolution_idx between 0 and 49",
    "legacy_metadata": f"with {_PARSED} {_LEGACY}",
    "aggregate_scores": f"with {_PARSED}, {_SCORE}, lg as (select distinct * from ({_LEGACY})) select lg.*, round(raw, 6) percolation_score, round(normalized, 6) normalized_percolation_score from lg join (select distinct * from score) using (file_id)",
    "resolution_dirname": "select distinct resolution, 'res_' || replace(printf('%.3f', resolution), '.', 'p') dirname from scores where resolution is not null",
    "resolution_grid": "with g as (select i id, round(pow(10, -1 + 3.5 * i / 49), 3) as v from range(50) t(i)), s as (select round(resolution, 3) as v, count(*) n from scores where resolution is not null group by 1) select id, v as value, n from g join s using (v)",
    "k_grid": "with g as (select distinct round_even(pow(10, 1 + i * 2.0 / 8), 0)::bigint k from range(9) t(i)), s as (select clustering_k::bigint k, count(*) n from scores where clustering_k is not null group by 1) select k, n from g join s using (k)",
    "folder_name": f"with s as (select distinct method, data_type, distance, env_k, weighted from scores) select *, {_FOLDER} folder from s",
    "build_path": f"""with {_PARSED} select file_id, concat_ws('/', case when "method" = 'preexisting' then 'Preexisting_' || annotation_level else {_FOLDER} end,
        case when "method" = 'lda' then concat_ws('/', 'k_' || env_k, 'k_' || clustering_k) when "method" = 'kmeans' then 'k_' || clustering_k
             when "method" in ('leiden', 'phenograph') then coalesce('res_' || replace(printf('%.3f', resolution), '.', 'p'), 'res_' || resolution_idx) end, section || '.npy') rel_path from pm""",
    "derived_name": """with s as (select distinct weighted, env_k::bigint k from scores where env_k is not null) select 'localfreq' || case when weighted then '_w' else '' end || '_k' || k source, n,
        'localfreq' || case when weighted then '_w' else '' end || '_pca' || n || '_k' || k derived from s, (select unnest([15, 50]) n)""",
    "wildcard_features": "select distinct algorithm from scores where algorithm glob 'Leiden*Co*' or algorithm glob 'Kmeans_pca??_env_k_*'",
    "expected_outputs": f"with {_EXPECTED} select * from ex",
    "progress_report": f"with {_EXPECTED} select step, count(*) expected, count(h.rel_path) completed, round(100.0 * count(h.rel_path) / count(*), 6) percent from ex left join hv h using (rel_path) group by step",
    "pending_jobs": f"with {_EXPECTED} select * from ex where rel_path not in (select rel_path from hv where rel_path is not null)",
    "completed_semi": f"with {_EXPECTED}, c as (select regexp_extract(rel_path, '^(.*)/[^/]*$', 1) config, regexp_extract(rel_path, '([^/]*)$', 1) name from hv where rel_path is not null) select config, count(distinct name) have from c group by 1 having count(distinct name) = (select count(distinct name) from c)",
    "chunk_assign": "select chunk, count(*) n, min(file_id) \"first\", max(file_id) \"last\" from (select file_id, (row_number() over (order by file_id) - 1) // 500 + 1 chunk from (select distinct file_id from score_files where file_id is not null)) group by chunk",
    "calibration_sample": "with f as (select file_id, row_number() over (order by file_id) - 1 r, greatest(1, count(*) over () // 10) n from (select distinct file_id from score_files where file_id is not null)) select file_id from f where r % n = 0 and r // n < 10",
    "log_classify": rf"""with {_LOGS}, n as (select *, list_filter(string_split(text, e'\n'), lambda x: regexp_matches(x, '{_BAD}')) hits from lg)
        select id, regexp_matches(text, '{logs.any_of(logs.ERRORS)}') has_error, regexp_matches(text, '{logs.any_of(logs.WARNINGS)}') has_warning, not contains(text, 'Done SGE_TASK_ID') abnormal_end,
        case when len(hits) > 0 then least(len(hits), 5) when not contains(text, 'Done SGE_TASK_ID') then 1 else 0 end::int n_lines,
        case when len(hits) > 0 then trim(hits[1]) when not contains(text, 'Done SGE_TASK_ID') then 'Abnormal termination (last line): Processing 2 percolation jobs from chunk' end first_line from n""",
    "log_parse": f"with {_LOGS} select id, job job_id, file_id task_id, 2::bigint n_tasks, section is not null done, case when section is not null then coalesce(n_bytes, 0)::double end as seconds from lg",
    "log_durations": f"""with {_LOGS}, s as (select job job_id, case when section is not null then coalesce(n_bytes, 0)::double end s from lg)
        select job_id, count(*) n_logs, count(s) n_completed, count(*) - count(s) n_running, round(avg(s), 6) mean_s, min(s) least_s, max(s) most_s, round(sum(s) / nullif(count(s) * 2, 0), 6) per_task_s from s group by job_id""",
    "log_run_errors": rf"""with {_LOGS}, b as (select * from lg where regexp_matches(text, '{_BAD}') or section is null order by id limit 20)
        select id, file_id task_id, (lacks and file_path is not null)::bigint n_missing, case when lacks then file_path end first_missing, file_path || e'\tout\tedges\t100' first_job from b""",
    "file_type_counts": f"with {_LABELS} select config_id || '/' || section || '.npy' file_path, label, count(*) n from l group by config_id, section, label",
    "step_summary": f"with {_EXPECTED} select regexp_extract(rel_path, '^([A-Z][a-z]+)', 1) as \"method\", count(*) outputs, count(*) // (select count(distinct section) from sections) jobs from ex group by 1",
    "scores_sorted": "select row_number() over (order by algorithm nulls last, env_k nulls last, clustering_k nulls last, section_name nulls last, file_path nulls last, percolation_score nulls last, scored_at nulls last) - 1 place, file_path, percolation_score, count(*) n from scores group by algorithm, env_k, clustering_k, section_name, file_path, percolation_score, scored_at",
    "file_gaps": """with g as (select section, epoch_us(modified_at - lag(modified_at) over (partition by section order by modified_at, file_id)) / 1e6 s from score_files where section is not null and modified_at is not null)
        select section, count(s) n, round(avg(s), 6) mean_s, round(min(s), 6) least_s, round(max(s), 6) most_s from g where s is not null group by section""",
    "encode_annotations": f"with {_CODES} select cell_id, \"level\", code from codes",
    "annotation_summary": f"with {_CODES} select \"level\", count(distinct case when code >= 0 then code end) n_types, count(*) n_cells, count_if(code < 0)::bigint n_missing from codes group by \"level\"",
    "subsample_sections": """with s as (select section from (select distinct section from cells where section is not null) order by section limit 3),
        c as (select distinct section, cell_id from cells join s using (section) where cell_id is not null)
        select section, cell_id from (select *, row_number() over (partition by section order by md5('42|' || cell_id), cell_id) r from c) where r <= 50""",
}
