import pytest
from pyspark.sql import functions as F

from mosaiq.operators import compact
from mosaiq.session import filesystem, new_path


def files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, file_path string, file_text string, modified_at timestamp, extra string")


def test_keeps_every_row(spark):
    rows = [(i % 50, f"run_1/LeidenRawCosine/res_{i % 7}/s.01.score", None if i % 11 == 0 else "0.5", None, "x" * (i % 3)) for i in range(1000)] + [(None, None, None, None, None)] * 5
    df = files(spark, rows).repartition(64)
    out = compact.compact(df, new_path(spark, "t"), 1 << 20)
    assert compact.checksum(df) == compact.checksum(out)
    assert out.rdd.getNumPartitions() < 64


def test_never_overwrites_and_empty(spark):
    path = new_path(spark, "t")
    assert compact.compact(files(spark, []), path).count() == 0
    with pytest.raises(FileExistsError):
        compact.compact(files(spark, []), path)
    fs, p = filesystem(spark, path)
    assert fs.exists(p)


def test_checksum_sees_copies_and_nulls(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    b = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    c = spark.createDataFrame([(None, 1)], "a int, b int")
    d = spark.createDataFrame([(1, None)], "a int, b int")
    assert compact.checksum(a) != compact.checksum(b)
    assert compact.checksum(c) != compact.checksum(d)


def test_same_record_pairs(spark):
    p = "m/run_1/LeidenRawCosine/res_0/s.01.score"
    rows = [
        (1, p, "0.50000\t0.7", None, ""),
        (2, "n/run_1/LeidenRawCosine/res_0p100/s.01.npy.score", "0.50009", None, ""),
        (3, p, "0.50011", None, ""),
        (4, p, "0.50000\t0.8", None, ""),
        (5, "run_2/LeidenRawCosine/res_0/s.01.score", "0.50000", None, ""),
        (6, p, "nan", None, ""),
        (1, p, "0.50000\t0.7", None, ""),
        (None, p, "0.5", None, ""),
    ]
    got = {tuple(r) for r in compact.same_record_pairs(compact.score_records(files(spark, rows))).collect()}
    assert got == {(1, 2), (2, 3), (2, 4)}


def test_record_classes_and_hot_key(spark):
    df = spark.range(3000).select(F.col("id").alias("file_id"), F.lit("k").alias("record_key"), (F.col("id") % 3 * 0.1).alias("raw"), F.lit(None).cast("double").alias("normalized"))
    c = compact.record_classes(df)
    assert c.select("record_id").distinct().count() == 3
    assert {r["n_files"] for r in c.select("n_files").distinct().collect()} == {1000}


def test_records_with_other_normalized_scores_are_kept(spark):
    p = "m/run_1/LeidenRawCosine/res_0/s.01.score"
    texts = {1: "0.50005", 2: "0.5\t0.7", 3: "0.5\t0.8", 4: "0.5\t0.70005", 5: "0.6", 6: "0.60005", 7: "0.50009\t0.9", 8: "0.50018\t0.7", 9: "nan"}
    df = files(spark, [(i, p, t, None, f"x{i}") for i, t in texts.items()] + [(2, p, texts[2], None, "x2")])
    got = {r["file_id"]: (r["record_id"], r["n_files"]) for r in compact.record_classes(compact.score_records(df)).collect()}
    assert got == {1: (2, 3), 2: (2, 3), 4: (2, 3), 3: (3, 1), 5: (5, 2), 6: (5, 2), 7: (7, 1), 8: (8, 1)}
    kept = compact.kept_files(spark, df)
    assert sorted((r["file_id"], r["extra"]) for r in kept.collect()) == [(i, f"x{i}") for i in (2, 3, 5, 7, 8)]
    assert compact.compact_score_files(spark, df).columns == df.columns
