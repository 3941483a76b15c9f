from datetime import datetime, timedelta

import numpy as np

from mosaiq.operators import clustering, communities, features, similarity, vectors
from mosaiq.session import Scratch
from mosaiq.streaming import monitor


def test_leiden_two_triangles(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)], "src long, dst long")
    got = communities.leiden(e)
    lab = {r["id"]: r["community"] for r in got.collect()}
    assert lab[0] == lab[1] == lab[2] != lab[3] == lab[4] == lab[5]
    q = communities.modularity(e, got.withColumnRenamed("community", "label")).first()["modularity"]
    assert abs(q - 5 / 14) < 1e-9
    assert communities.leiden(e.limit(0)).count() == 0


def test_jaccard(spark):
    e = [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 0), (3, 3), (3, -1)]
    df = spark.createDataFrame(e, "src long, dst long")
    got = {(r["src"], r["dst"]): r["similarity"] for r in similarity.jaccard_topk(df, 5).collect()}
    sets = {0: {1, 2}, 1: {0, 2}, 2: {0, 1}, 3: {0}}
    want = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in sets for j in sets if i != j and any(j in sets[m] for m in sets[i]) and sets[i] & sets[j]}
    assert got == want


def test_feature_knn(spark):
    x = np.random.default_rng(0).normal(size=(200, 6)).astype(np.float32)
    df = spark.createDataFrame([*[(i, [float(v) for v in r]) for i, r in enumerate(x)], (900, None), (901, [1.0])], "id long, e array<float>")
    for metric in similarity.METRICS:
        p = similarity.prepared(x, metric)
        d = ((p[:, None] - p[None]) ** 2).sum(2)
        np.fill_diagonal(d, np.inf)
        want = np.argsort(d, axis=1, kind="stable")[:, :4]
        got = similarity.query_knn(df.where("id % 20 = 0"), df, "id", "e", 6, 4, metric).collect()
        assert {(r["src"], r["k"]): r["dst"] for r in got} == {(i, k + 1): int(want[i, k]) for i in range(0, 200, 20) for k in range(4)}
        g = similarity.feature_graph(df, "id", "e", 6, 4, metric, trees=6, leaf=40).collect()
        assert sum(r["dst"] in want[r["src"]] for r in g) / (4 * 200) >= 0.9


def test_clustering_invariants(spark):
    rng = np.random.default_rng(42)
    blobs = np.concatenate([rng.normal(0, 1, (50, 10)) + 5 * np.eye(10)[i] * 2 for i in range(3)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(blobs)], "cell_id long, f array<double>")
    assert clustering.kmeans(df, "f", 3).select("label").distinct().count() == 3
    counts = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.poisson(5, (50, 10)))], "cell_id long, f array<double>")
    t = clustering.lda(counts, "f", 3).collect()
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-5 and 0 <= r["label"] < 3 for r in t)
    p = np.array([r["pca"] for r in features.pca(df, "f", 2).orderBy("cell_id").collect()])
    assert np.allclose(p.mean(0), 0, atol=1e-8) and p.var(0)[0] >= p.var(0)[1]


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def test_stuck_stream_and_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    h = timedelta(hours=1)
    rows = [(1, 1, t), (2, 1, t + 2 * h), (3, 2, t + h), (4, 1, t + 30 * h), (5, 3, t + 31 * h), (6, None, t), (7, 1, None)]
    got = {(r["user_id"], r["last_seen"]) for r in monitor.stuck_batch(events(spark, rows), "user_id", "ts", 12 * 3600).collect()}
    assert got == {(1, t + 2 * h)}
    for i, part in enumerate((rows[:3] + rows[5:], rows[3:5], [(8, 3, t + 40 * h)])):
        events(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"p{i}"))
    src = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = monitor.stuck_stream(src, "user_id", "ts", 12 * 3600).writeStream.format("memory").queryName("stuck").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        out = {(r["key"], r["last_seen"]) for r in spark.sql("select * from stuck").collect()}
    finally:
        q.stop()
    assert out == {(1, t + 2 * h), (2, t + h)}


def test_leaves_stay_small(spark):
    """Levels that the sample can't tell apart are fitted below the leaves, so that these don't grow with the rows."""
    x = np.random.default_rng(4).normal(0, 1, (6000, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>")
    size = lambda **kw: [r["count"] for r in vectors.grouped(df, "id", "v", 5, 6000, 2, 50, 1, **kw).groupBy("leaf").count().collect()]
    coarse, fine = size(sample_rows=64, per_leaf=8), size(sample_rows=64, per_leaf=1024)
    assert sum(coarse) == sum(fine) == 12000 and max(coarse) > 400 and max(fine) < 250


def test_connected_by_joins_and_in_a_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = [tuple(map(int, rng.integers(0, 120, 2))) for _ in range(70)]
    df = spark.createDataFrame(pairs, "u long, v long")
    got = []
    for most in (3, 1000):
        monkeypatch.setattr(communities, "IN_ONE_TASK", most)
        got.append({(r["id"], r["root"]) for r in communities.connected(Scratch(spark, "test"), df).collect()})
    assert got[0] == got[1] and all(root <= i for i, root in got[0])
    root = dict(got[0])
    assert all(root[a] == root[b] for a, b in pairs if a != b)
