import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import paths
from mosaiq.operators import clustering, communities, features, results
from mosaiq.plans.run import ComparisonConfig, RunConfig
from mosaiq.sources import files


def test_label_folder(spark):
    df = spark.createDataFrame([("A", None, 0.1, 3, 4.0), ("A", "B", None, 3, 4.0), ("A", None, None, None, 4.0), ("A", None, None, None, None)], "algorithm string, algorithm_string string, resolution double, resolution_idx int, clustering_k double")
    assert [r["x"] for r in df.select(paths.label_folder(df.columns).alias("x")).collect()] == ["A/res_0p100", "B/res_3", "A/k_4", "A"]
    one = df.select("algorithm").limit(1)
    assert one.select(paths.label_folder(one.columns).alias("x")).first()["x"] == "A"


def test_features_with_section_and_derived(spark):
    df = spark.createDataFrame([(i, "s" if i % 2 else None, [float(i), 1.0, float(i * i)]) for i in range(10)], "cell_id long, section string, features array<double>")
    got = {r["cell_id"]: r for r in features.for_clustering(df, "raw").collect()}
    assert got[1]["section"] == "s" and got[2]["section"] == "0" and got[3]["features"] == [3.0, 1.0, 9.0]
    assert features.section_column(df.drop("section")) is None
    with pytest.raises(ValueError):
        features.section_column(df, "nope")
    assert len(features.derive(df, "pca", 2).first()["features"]) == 2
    assert features.derive(df, "standardise").where("cell_id = 0").first()["features"][1] == 0
    assert features.derive(df, "log1p").where("cell_id = 1").first()["features"][0] == pytest.approx(np.log(2))
    with pytest.raises(ValueError):
        features.derive(df, "nope")


def test_sweeps(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, (rng.normal(0, 0.1, 3) + 5 * (i % 3)).tolist()) for i in range(60)], "cell_id long, v array<double>")
    n = {r["config_id"]: r["n"] for r in clustering.kmeans_sweep(df, "v", [2, 3], components=2).groupBy("config_id").agg(F.countDistinct("label").alias("n")).collect()}
    assert n == {"k_2": 2, "k_3": 3}
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3), (6, 7)], "src long, dst long")
    cells = spark.range(9).selectExpr("'s' as section", "id as cell_id")
    got = {r["cell_id"]: r["label"] for r in communities.leiden_sections(e, cells, [1.0]).where("config_id = 'res_1p000'").collect()}
    assert [got[i] for i in range(9)] == [0, 0, 0, 1, 1, 1, 2, 2, 3]
    assert communities.choose_resolution(0.5) == 0.5 and communities.choose_resolution(index=0) == pytest.approx(0.1) and communities.choose_resolution() == pytest.approx(10 ** (-1 + 3.5 * 25 / 49))


def test_curves_stored_and_scored_again(spark, tmp_path):
    rows = [(s, v, i, i / 4, h, 4) for s, hs in (("a", ((2.0, 1.5, 1.0), (2.0, 2.0, 2.0))), ("b", ((2.0, 1.0, None), (2.0, 2.0, 2.0))), ("c", ((2.0, 1.0, 1.0),))) for v, h3 in enumerate(hs) for i, h in enumerate(h3, 1)]
    df = spark.createDataFrame(rows, "section string, variant byte, step int, pbond double, entropy double, n long")
    files.write_curves(df, f"{tmp_path}/curves")
    got = files.rescore(spark, f"{tmp_path}/curves").collect()
    assert [(r["section"], r["raw"], r["normalized"]) for r in got] == [("a", 0.25, 0.125)]
    assert files.rescore(spark, f"{tmp_path}/curves", ["b"]).count() == 0


def test_snapshot_and_order(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None), ("a", 1), (None, 3)], "k string, n int")
    assert [(r["place"], r["k"], r["n"]) for r in results.in_order(df, ["k", "n"]).orderBy("place").collect()] == [(0, "a", 1), (1, "a", None), (2, "b", 2), (3, None, 3)]
    files.write_snapshot(df, ["k", "n"], f"{tmp_path}/snap")
    assert {(r["_row_idx"], r["k"]) for r in spark.read.csv(f"{tmp_path}/snap", header=True).collect()} == {("0", "a"), ("1", "a"), ("2", "b"), ("3", None)}


def test_run_and_comparison_settings(spark, tmp_path):
    c = RunConfig({"run_name": "r", "input": {}, "output": {"base_dir": "/o/", "scores_csv": "s.csv", "logs_dir": "/logs"}, "steps": {"features": {"types": ["raw", "scvi"]}, "graphs": {"k": 20, "distances": ["cosine"]}, "clustering": {"methods": [{"method": "phenograph", "distances": ["cosine"], "n_resolutions": 2, "k_jaccard": 10}] * 2}}})
    assert c.phenographs == [("raw", "cosine", 10), ("scvi", "cosine", 10)] and c.graph_k == 20 and c.percolation_max_k == 100
    assert (c.path("scores_csv"), c.path("logs_dir"), c.path("clustering_dir")) == ("/o/s.csv", "/logs", "/o/clustering")
    c.write_manifest(spark, spark.createDataFrame([("s1",), ("s2",)], "section string"), f"{tmp_path}/m")
    m = json.loads(spark.read.text(f"{tmp_path}/m").first()["value"])
    assert m["run_name"] == "r" and m["expected"]["features"] == 2
    raw = {"input": {"configs_csv": "c", "clustering_dir": "d"}, "output": {"base_dir": "o"}, "comparison": {"id_cols": ["method"], "min_labels": 2}}
    assert ComparisonConfig.of(raw) == ComparisonConfig("c", "d", "o", None, ("method",), 2)
    with pytest.raises(ValueError):
        ComparisonConfig.of({"input": {}})
