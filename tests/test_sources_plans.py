import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import grids
from mosaiq.operators import logs, results
from mosaiq.plans import run
from mosaiq.sources import arrays, files


def test_arrays(spark, tmp_path):
    for s, n in (("a.01", 3), ("b.02", 2)):
        np.save(tmp_path / f"{s}_XY.npy", np.arange(2.0 * n).reshape(n, 2))
    got = arrays.read_coordinates(spark, str(tmp_path)).collect()
    assert sorted((r["section"], r["cell_id"], r["x"], r["y"]) for r in got)[2] == ("a.01", 2, 4.0, 5.0) and len(got) == 5
    lab = tmp_path / "labels" / "Leiden" / "res_1"
    lab.mkdir(parents=True)
    np.save(lab / "a.01.npy", np.array([2, 0, 1], np.int32))
    df = arrays.read_labels(spark, str(tmp_path / "labels"))
    assert {(r["config_id"], r["section"], r["cell_id"], r["label"]) for r in df.collect()} == {("Leiden/res_1", "a.01", 0, 2), ("Leiden/res_1", "a.01", 1, 0), ("Leiden/res_1", "a.01", 2, 1)}
    arrays.write_labels(df, str(tmp_path / "out"))
    assert arrays.labels_of(spark, str(tmp_path / "out"), "Leiden/res_1", ["a.01", "none"]).count() == 3
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        arrays.read_coordinates(spark, str(tmp_path / "empty"))


def test_score_files_and_jobs(spark, tmp_path):
    d = tmp_path / "res" / "LeidenRawCosine" / "res_1p000"
    d.mkdir(parents=True)
    (d / "s.01.score").write_text("0.5\t0.7\n")
    (d / "s.02.score").write_text("broken")
    got = files.aggregate_score_files(files.read_score_files(spark, str(tmp_path / "res")), f"file://{tmp_path}/res/").collect()
    assert [(r["algorithm"], r["resolution"], r["section_name"], r["percolation_score"]) for r in got] == [("LeidenRawCosine", 1.0, "s.01", 0.5)]
    (tmp_path / "jobs.txt").write_text("# head\n a\tb \n\nc\n")
    assert sorted(r["job"] for r in files.read_job_list(spark, str(tmp_path / "jobs.txt")).collect()) == ["a\tb", "c"]
    (tmp_path / "f.csv").write_text("sec,x,name,y\nS1,1,a,2.5\n")
    r = files.read_csv_features(spark, str(tmp_path / "f.csv")).first()
    assert (r["section"], r["features"]) == ("S1", [1.0, 2.5])


CONFIG = {
    "run_name": "t",
    "input": {},
    "output": {},
    "steps": {
        "features": {"types": ["raw", "scvi"], "local_frequency": {"k_values": [20, 50], "weighted": [False, True]}, "derived": [{"sources": "localfreq*", "n_components": [15, 50]}]},
        "graphs": {"distances": ["cosine"]},
        "clustering": {"methods": [{"method": "leiden", "data_types": ["raw", "localfreq_pca*"], "distances": ["cosine"], "n_resolutions": 2}, {"method": "preexisting", "levels": ["class"]}]},
    },
}


def test_run_config(spark):
    c = run.RunConfig(CONFIG)
    assert c.base_features == ["raw", "scvi", "localfreq_k20", "localfreq_w_k20", "localfreq_k50", "localfreq_w_k50"]
    assert c.dependencies["localfreq_w_pca15_k20"] == "localfreq_w_k20" and len(c.features) == 14
    sections = spark.createDataFrame([("S1",), ("S2",)], "section string")
    e = run.expected(spark, c, sections)
    n = {r["step"]: r["count"] for r in e.groupBy("step").count().collect()}
    assert n == {"features": 14, "graphs": 14, "clustering": 5 * 2 * 2, "percolation": 5 * 2 * 2 + 2}
    done = e.where("step = 'percolation'").limit(11)
    s = {r["step"]: r for r in run.status(spark, c, sections, done).collect()}
    assert s["percolation"]["percent"] == 50 and s["features"]["completed"] == 0
    assert run.pending(spark, c, sections, done).count() == 14 + 14 + 20 + 11
    with pytest.raises(ValueError):
        run.RunConfig({"run_name": "x"})
    with pytest.raises(ValueError):
        run.matching(["a"], "b")


HEAD = "Processing chunk: chunk_{0:04d}_of_0010.txt\nTask ID: {0}\nStart time: Mon Feb  9 00:00:00 PST 2026\nProcessing 2 percolation jobs from chunk\n"
TAIL = "End time: Mon Feb 9 00:01:05 PST 2026\nDone SGE_TASK_ID {0}\n"
LOGS = {
    "run_clustering.123.7.log": HEAD.format(7),
    "test_run_percolation.111.1.log": HEAD.format(1) + "  Skipping missing file: /tmp/missing.npy\n" + TAIL.format(1),
    "test_run_percolation.111.2.log": HEAD.format(2) + "finance abandoned, no errors\n" + TAIL.format(2),
    "test_run_percolation.111.3.log": HEAD.format(3) + "x\r\n error: disk \n" * 7 + TAIL.format(3),
    "odd name": "",
    "nothing.1.2.log": None,
}


def test_logs(spark):
    df = spark.createDataFrame(list(LOGS.items()), "id string, text string")
    c = {r["id"]: r for r in logs.classify(df).collect()}
    flags = {k: (r["has_error"], r["has_warning"], r["abnormal_end"], r["suspicious"]) for k, r in c.items()}
    names = list(LOGS)
    assert [flags[n] for n in names] == [(False, False, True, True), (False, True, False, True), (False,) * 4, (True, False, False, True), (False,) * 4, (False,) * 4]
    assert c[names[0]]["lines"] == ["Abnormal termination (last line): Processing 2 percolation jobs from chunk"]
    assert c[names[1]]["lines"] == ["Skipping missing file: /tmp/missing.npy"] and c[names[3]]["lines"] == ["error: disk"] * 5
    p = {r["id"]: r for r in logs.parse(df).collect()}
    assert (p[names[0]]["job_id"], p[names[0]]["task_id"], p[names[0]]["seconds"], p[names[0]]["n_tasks"], p[names[0]]["chunk"]) == ("123", 7, None, 2, "chunk_0007_of_0010.txt")
    assert p[names[1]]["seconds"] == 65 and p["odd name"]["task_id"] is None and p["odd name"]["n_tasks"] == 1
    d = logs.durations(logs.parse(df), ["job_id"]).where("job_id = '111'").first()
    assert (d["n_logs"], d["n_completed"], d["n_running"], d["mean_s"], d["per_task_s"]) == (3, 3, 0, 65, 32.5)


def test_run_errors(spark):
    """Warning logs are mapped to the missing outputs and job lines of their tasks."""
    line = "LeidenRawCosine/res_0/{}.npy\t/o/percolation_results\t/o/edge_lists\t100\t/xy\t/o/clustering"
    jobs = spark.createDataFrame([("percolation", 1, line.format(s)) for s in ("S1", "S2")] + [("features", 2, "features\tin.h5ad\traw"), ("graphs", 3, "f.npy\t/o/graphs/graph_raw_cosine.npz"), ("clustering", 4, "g\tx\t/o/clustering/LeidenRawCosine\t0"), ("aggregation", 5, "a\t/o/scores.csv\tc\td\t/o/reduced.csv"), ("graphs", 6, "short")], "step string, task_id int, job_line string")
    out = logs.job_outputs(jobs, spark.createDataFrame([("S1",), ("S2",)], "section string"), "/o")
    got = {}
    for r in out.collect():
        got.setdefault(r["task_id"], set()).add(r["rel_path"])
    assert got == {1: {"LeidenRawCosine/res_0/S1.score", "LeidenRawCosine/res_0/S2.score"}, 2: {"features_raw.npy"}, 3: {"graph_raw_cosine.npz"}, 4: {"LeidenRawCosine/res_0p100/S1.npy", "LeidenRawCosine/res_0p100/S2.npy"}, 5: {"scores.csv", "reduced.csv"}}
    df = spark.createDataFrame(list(LOGS.items()), "id string, text string")
    found = logs.classify(df).join(logs.parse(df).select("id", F.col("task_id").cast("int").alias("task_id")), "id").withColumn("step", F.lit("percolation"))
    r = {x["task_id"]: x for x in logs.run_errors(found, out, out.where("task_id = 1"), max_missing=1).collect()}
    assert set(r) == {1, 3, 7} and r[1]["n_missing"] == 2 and r[1]["missing"] == ["LeidenRawCosine/res_0/S1.score"] and len(r[1]["jobs"]) == 2 and r[7]["n_missing"] == 0


def test_calibration(spark):
    df = spark.createDataFrame([("a", 'total_time_seconds: 2.5\n"total_time_seconds": 1'), ("b", "Processed x.npy in 3 seconds"), ("c", "nothing"), ("d", None)], "id string, text string")
    assert {(r["id"], r["n_files"], r["total_s"], r["least_s"]) for r in logs.calibration(df).collect()} == {("a", 2, 3.5, 1.0), ("b", 1, 3.0, 3.0)}


def test_ari(spark):
    rows = [(c, "s", i, f(i)) for c, f in (("x", lambda i: i % 3), ("y", lambda i: (i % 3 + 1) % 3), ("z", lambda i: i % 2)) for i in range(60)]
    lab = results.distinct_labels(spark.createDataFrame(rows + [("x", "s", 5, -1), ("x", "s", None, 1)], "config_id string, section string, cell_id long, label int"))
    got = {(r["config_1"], r["config_2"]): r["ari"] for r in results.adjusted_rand(results.contingency(lab)).collect()}
    assert got[("x", "y")] == 1.0 and abs(got[("x", "z")]) < 0.1 and len(got) == 3


def test_union_chunks(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, s double")
    assert results.union_chunks(("id",), a, a.drop("s")).count() == 2
    with pytest.raises(ValueError):
        results.union_chunks(("nope",), a)


def test_chunks_hot(spark):
    c = results.chunks(spark.range(1003), ["id"], 100).groupBy("chunk").count().collect()
    assert sorted(r["count"] for r in c) == [3] + [100] * 10
