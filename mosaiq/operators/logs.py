"""Log texts of a run: parsing, classification, durations, and which jobs and outputs a log stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Patterns that mark errors and warnings in logs, and the lines at a job's start and end. Case is ignored.
ERRORS = (r"\bERROR\b", "Traceback", r"\bException\b", "MemoryError", "Segmentation fault", r"\bkilled\b", "No chunk file found")
WARNINGS = ("Skipping missing file", r"Skipping \(no XY file\)", r"Skipping \(XY/type mismatch\)", "Skipping malformed job")
STARTED, DONE, COMPLETED = "Start time:", "Done SGE_TASK_ID", r"Completed \d+ .* jobs"
START_LINE, END_LINE = r"Start time: (?:\w+ +)?(.+)", r"End time: (?:\w+ +)?(.+)"
CHUNK_LINE, TASKS_LINE = "Processing chunk: (.+)", r"Processing (\d+) .+ jobs from chunk"
FILE_NAME, CHUNK_NAME = r"\.(\d+)\.(\d+)\.log$", r"chunk_(\d+)_of_\d+\.txt$"
SECONDS, SECONDS_ELSE = r'total_time_seconds["\s:]+(\d+\.?\d*)', r"Processed .* in (\d+\.?\d*) seconds"
MOST_LINES = 5  # lines quoted of a log


def any_of(words: tuple[str, ...]) -> str:
    return "(?i)" + "|".join(f"(?:{w})" for w in words)


def _when(text: Column, line: str) -> Column:
    """The time on a line such as ``Mon Feb 9 00:00:00 PST 2026``; the name of the zone is left out, as differences matter."""
    parts = F.regexp_extract(text, line, 1)
    clean = F.regexp_replace(F.regexp_replace(F.trim(parts), r"\s+[A-Z]{2,5}\s+(\d{4})$", " $1"), r"\s+", " ")
    return F.try_to_timestamp(clean, F.lit("MMM d HH:mm:ss yyyy"))


def classify(texts: DataFrame) -> DataFrame:
    """Add to (id, text) has_error, has_warning, abnormal_end, suspicious (any of these) and lines.

    abnormal_end: started but not done. lines are the first lines that speak for errors or warnings, trimmed, at most
    MOST_LINES; of a log that ended abnormally without such lines, its last line that isn't blank. Null texts are empty.
    """
    t = texts.withColumn("text", F.coalesce("text", F.lit("")))
    has = lambda p: F.col("text").rlike(p)
    end = has(f"(?i){STARTED}") & ~has(f"(?i){DONE}")
    split = F.split("text", r"\r\n|\r|\n")
    hits = F.slice(F.transform(F.filter(split, lambda x: x.rlike(any_of(ERRORS + WARNINGS))), lambda x: F.trim(x)), 1, MOST_LINES)
    said = F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")
    last = F.when(F.size(said) > 0, F.concat(F.lit("Abnormal termination (last line): "), F.try_element_at(said, F.lit(-1)))).otherwise("Abnormal termination (empty log file)")
    t = t.withColumn("has_error", has(any_of(ERRORS))).withColumn("has_warning", has(any_of(WARNINGS))).withColumn("abnormal_end", end).withColumn("_hits", hits)
    t = t.withColumn("lines", F.when((F.size("_hits") == 0) & F.col("abnormal_end"), F.array(last)).otherwise(F.col("_hits")))
    return t.withColumn("suspicious", F.col("has_error") | F.col("has_warning") | F.col("abnormal_end")).drop("_hits")


def parse(texts: DataFrame) -> DataFrame:
    """(id, job_id, task_id, started, ended, seconds, chunk, n_tasks, done) of logs (id, text[, modified]); id is the file's name.

    A log without an end line that is done ends when its file was last modified, if that column is there; one that isn't
    done has no end. job_id and task_id come from names that end in ``.<job>.<task>.log``, else they are null. A log
    that doesn't say how many tasks it has counts as one.
    """
    text = F.coalesce("text", F.lit(""))
    done = text.rlike(DONE) | text.rlike(COMPLETED)
    modified = F.col("modified").cast("timestamp") if "modified" in texts.columns else F.lit(None).cast("timestamp")
    num = lambda c, p, g: F.regexp_extract(c, p, g).try_cast("bigint")
    started = _when(text, START_LINE)
    ended = F.coalesce(_when(text, END_LINE), F.when(done, modified))
    p = texts.select("id", F.nullif(F.regexp_extract("id", FILE_NAME, 1), F.lit("")).alias("job_id"), num("id", FILE_NAME, 2).alias("task_id"), started.alias("started"), ended.alias("ended"), F.nullif(F.regexp_extract(text, CHUNK_LINE, 1), F.lit("")).alias("chunk"), F.coalesce(num(text, TASKS_LINE, 1), F.lit(1)).alias("n_tasks"), done.alias("done"))
    return p.withColumn("seconds", (F.unix_micros("ended") - F.unix_micros("started")) / 1e6)


def durations(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_logs, n_completed, n_running, mean_s, least_s, most_s, per_task_s) of parsed logs; per_task_s goes by their numbers of tasks."""
    s = F.col("seconds")
    g = parsed.groupBy(*keys).agg(F.count("*").alias("n_logs"), F.count(s).alias("n_completed"), F.count_if(F.col("ended").isNull()).alias("n_running"), F.avg(s).alias("mean_s"), F.min(s).alias("least_s"), F.max(s).alias("most_s"), F.sum(s).alias("_s"), F.sum(F.when(s.isNotNull(), F.col("n_tasks"))).alias("_n"))
    return g.withColumn("per_task_s", F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).drop("_s", "_n")


def calibration(texts: DataFrame) -> DataFrame:
    """(id, n_files, total_s, mean_s, least_s, most_s) of the seconds that a calibration log reports for its files."""
    every = lambda p: F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda x: x.cast("double"))
    times = F.when(F.size(every(SECONDS)) > 0, every(SECONDS)).otherwise(every(SECONDS_ELSE))
    e = texts.where("text is not null").select("id", F.explode(times).alias("s"))
    return e.groupBy("id").agg(F.count("*").alias("n_files"), F.sum("s").alias("total_s"), F.avg("s").alias("mean_s"), F.min("s").alias("least_s"), F.max("s").alias("most_s"))


def job_outputs(jobs: DataFrame, sections: DataFrame, base: str = "", n_resolutions: int = 50) -> DataFrame:
    """(step, task_id, job_line, rel_path): the outputs that each job of (step, task_id, job_line) should make.

    Fields of a line are parted by TAB. features: the file of the last part of field 3; graphs: field 2; clustering:
    one file per section below field 3 and the resolution of index field 4; percolation: the score of field 1;
    aggregation: field 2, and field 5 if there is one. Paths below ``base`` and a folder of the step are relative.
    Lines of other layouts make none.
    """
    from mosaiq.functions import grids, paths

    f = F.split("job_line", "\t")
    part = lambda n: F.get(f, F.lit(n - 1))
    head = base.rstrip("/")
    rel = lambda c: F.regexp_replace(c, rf"^\Q{head}\E/(?:(?:graphs|clustering|percolation[a-z_]*)/)?", "") if head else c
    res = grids.resolution_dirname(paths.grid_value(part(4).try_cast("int"), n=n_resolutions))
    none = F.array().cast("array<string>")
    one = (
        F.when((F.col("step") == "features") & (F.size(f) >= 3), F.array(F.concat(F.lit("features_"), part(3), F.lit(".npy"))))
        .when((F.col("step") == "graphs") & (F.size(f) >= 2), F.array(rel(part(2))))
        .when((F.col("step") == "clustering") & (F.size(f) >= 4), F.array(F.concat_ws("/", rel(part(3)), res)))
        .when(F.col("step") == "percolation", F.array(F.regexp_replace(part(1), r"\.npy$", ".score")))
        .when((F.col("step") == "aggregation") & (F.size(f) >= 5), F.array(rel(part(2)), rel(part(5))))
        .when((F.col("step") == "aggregation") & (F.size(f) >= 2), F.array(rel(part(2))))
        .otherwise(none)
    )
    o = jobs.select("step", "task_id", "job_line", F.explode(one).alias("out"))
    s = sections.select("section").distinct()
    c = o.where("step = 'clustering'").crossJoin(F.broadcast(s)).withColumn("out", F.concat_ws("/", "out", F.concat("section", F.lit(".npy")))).drop("section")
    return o.where("step <> 'clustering'").unionByName(c).withColumnRenamed("out", "rel_path")


def run_errors(found: DataFrame, outputs: DataFrame, missing: DataFrame, max_logs: int = 20, max_missing: int = 5, max_jobs: int = 5) -> DataFrame:
    """Suspicious logs (step, id, task_id, flags of classify) with the missing outputs and the jobs of their task.

    Columns n_missing, missing and jobs: how many outputs of the task are missing, and the first of them and of its job
    lines by name, at most max_missing and max_jobs. The first max_logs logs by step and id are reported.
    """
    m = outputs.join(missing.select("step", "rel_path").distinct(), ["step", "rel_path"])
    first = lambda df, c, n: df.select("step", "task_id", c).distinct().withColumn("_n", F.row_number().over(W.partitionBy("step", "task_id").orderBy(c))).where(F.col("_n") <= n).groupBy("step", "task_id").agg(F.array_sort(F.collect_list(c)))
    n = m.groupBy("step", "task_id").agg(F.countDistinct("rel_path").alias("n_missing"))
    logs = found.where("suspicious").orderBy("step", "id").limit(max_logs)
    j = logs.join(n, ["step", "task_id"], "left").join(first(m, "rel_path", max_missing).toDF("step", "task_id", "missing"), ["step", "task_id"], "left")
    j = j.join(first(outputs, "job_line", max_jobs).toDF("step", "task_id", "jobs"), ["step", "task_id"], "left")
    return j.withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))


def gaps(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """(key, n, mean_s, least_s, most_s) of the seconds between successive rows of a key."""
    w = W.partitionBy(key).orderBy(ts, tie)
    s = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w))) / 1e6
    g = rows.where(F.col(ts).isNotNull()).select(key, s.alias("s")).where("s is not null")
    return g.groupBy(key).agg(F.count("*").alias("n"), F.avg("s").alias("mean_s"), F.min("s").alias("least_s"), F.max("s").alias("most_s"))
