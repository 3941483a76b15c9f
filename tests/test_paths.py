"""Path metadata: forms of the current and older layouts."""

import pytest
from pyspark.sql import functions as F

from mosaiq.functions import grids, paths


def parse(spark, path, base="/results/"):
    df = spark.createDataFrame([(path,)], "p string")
    return df.select(paths.parse_path(F.col("p"), base).alias("m")).first()["m"]


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("/results/LeidenRawCorrelation/res_5/C57BL6J-638850.40.npy", {"method": "leiden", "feature_type": "celltype", "data_type": "raw", "distance": "correlation", "resolution_idx": 5, "section": "C57BL6J-638850.40"}),
        ("/results/LeidenRawCorrelation_envenv_w_k_20/res_2/C57BL6J-638850.40.npy", {"method": "leiden", "feature_type": "env", "weighted": True, "env_k": 20, "resolution_idx": 2}),
        ("/results/LeidenPCA50Euclidean/res_10/section1.npy", {"data_type": "pca50", "distance": "euclidean", "section": "section1"}),
        ("/results/Kmeans_env_k_50/k_100/section1.npy", {"method": "kmeans", "feature_type": "env", "env_k": 50, "clustering_k": 100}),
        ("/results/LDA/k_50/k_100/section1.npy", {"method": "lda", "env_k": 50, "clustering_k": 100}),
        ("/results/LeidenRawCosine/res_0p100/s.01.score", {"resolution": 0.1, "resolution_idx": None, "section": "s.01"}),
        ("/results/PhenoGraphSCVIEuclidean_res_9/s.01.score.bak", {"method": "phenograph", "data_type": "scvi", "resolution_idx": 9, "section": "s.01"}),
        ("/results/./x/../Allen_class//s.01.npy", {"method": "preexisting", "annotation_level": "class"}),
        ("/results/other/env_k_3/k_7/s.npy", {"method": "other", "env_k": 3, "clustering_k": 7}),
    ],
)
def test_parse(spark, path, want):
    got = parse(spark, path).asDict()
    assert {k: got[k] for k in want} == want


def test_too_short_and_null(spark):
    assert parse(spark, "/results/x.npy") is None
    assert parse(spark, None) is None


def test_same_configuration(spark):
    forms = ["LeidenRawCosine/res_0/s.01.npy", "LeidenRawCosine/res_0p100/s.01.npy", "LeidenRawCosine_res_0/s.01.npy"]
    df = spark.createDataFrame([(p,) for p in forms], "p string").select(paths.same_configuration(paths.parse_path(F.col("p"))).alias("k"))
    assert len({r["k"] for r in df.collect()}) == 1


def test_score_text(spark):
    texts = ["0.5", " 0.5\t0.7 \r\n", "a\tb\tc\t0.25", "a\tb\t0.1", "nan", "", None, "0.5\tnan", "1e-1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(paths.score_text(F.col("t")).alias("s"))
    got = [None if r["s"] is None else (r["s"]["raw"], r["s"]["normalized"]) for r in df.collect()]
    assert got == [(0.5, None), (0.5, 0.7), (0.25, None), None, None, None, None, None, (0.1, None)]


def test_round_trip(spark):
    p = "LeidenRawCorrelation_envenv_w_k_20/res_1p000/C57BL6J-638850.40.npy"
    df = spark.createDataFrame([(p,)], "p string")
    assert df.select(paths.build_path(paths.parse_path(F.col("p"))).alias("b")).first()["b"] == p


def test_grids(spark):
    r = grids.resolution_values()
    assert len(r) == 50 and r == sorted(r) and abs(r[0] - 0.1) < 1e-12
    ten = grids.resolution_values(10, 0, 1)
    assert ten[0] == 1 and abs(ten[-1] - 10) < 1e-12
    k = grids.k_values()
    assert k == sorted(set(k)) and k[0] == 10 and k[-1] == 1000
    one = spark.range(1)
    assert one.select(grids.resolution_dirname(F.lit(316.227766)).alias("x")).first()["x"] == "res_316p228"
    assert one.select(grids.derived_name(F.lit("localfreq_w_k50"), F.lit("pca"), F.lit(15)).alias("x")).first()["x"] == "localfreq_w_pca15_k50"
    assert one.select(grids.chunk_size(F.lit(0.15)).alias("x")).first()["x"] == 19200


def test_localfreq_names_both_ways(spark):
    one = spark.range(1)
    for dt, folder in (("localfreq_k50", "LeidenLocalfreqK50Cosine"), ("localfreq_w_k100", "LeidenLocalfreqWK100Cosine"), ("localfreq_pca15_k50", "LeidenLocalfreqPca15K50Cosine"), ("scvi", "LeidenSCVICosine")):
        null = F.lit(None).cast("boolean")
        assert one.select(grids.folder_name(F.lit("leiden"), F.lit(dt), F.lit("cosine"), F.lit(None).cast("int"), null).alias("x")).first()["x"] == folder
        m = one.select(paths.parse_path(F.lit(f"{folder}/res_0p100/S.01.npy")).alias("m")).first()["m"]
        assert (m["data_type"], m["distance"], m["resolution"]) == (dt, "cosine", 0.1) and folder == f"Leiden{grids.data_type_name(dt)}Cosine"
