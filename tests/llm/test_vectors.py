import numpy as np
import pytest

from mosaiq.llm import density, neighbours
from mosaiq.operators import communities
from mosaiq.session import Scratch


def table(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "cell_id long, x_pca array<float>, v string")


def blobs(rng, n=(200, 150, 100), dim=4, gap=8.0):
    return np.concatenate([rng.normal(0, 0.3, (m, dim)) + gap * i for i, m in enumerate(n)]).astype(np.float32)


BAD = [(9001, None, "c"), (9002, [1.0, 2.0], "c"), (9003, [float("nan")] * 4, "c"), (None, [0.0] * 4, "c"), (9004, [], "c")]


def knn(x, k):
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return d, [sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))]


def test_nn_descent_recall_and_bad_rows(spark):
    x = blobs(np.random.default_rng(0))
    df = table(spark, x, [*BAD, (0, [float(v) for v in x[0]], "c")])
    got = neighbours.nn_descent(df, "cell_id", "x_pca", 4, k=5, trees=3, leaf=40).collect()
    _, want = knn(x, 5)
    hit = sum(r["dst"] in want[r["src"]] for r in got)
    assert hit / (5 * len(x)) >= 0.95
    assert all(r["src"] != r["dst"] for r in got) and max(r["rank"] for r in got) == 5


def test_near_pairs_with_copies(spark):
    x = np.random.default_rng(1).normal(0, 1, (120, 4)).astype(np.float32)
    x[20:80] = x[20]  # more copies than are searched one by one
    x[85] = x[84]
    got = {(r["id_1"], r["id_2"]) for r in neighbours.near_pairs(table(spark, x), "cell_id", "x_pca", 4, 0.1, k=5).collect()}
    d, near = knn(x, 5)
    want = {(min(i, j), max(i, j)) for i in range(len(x)) for j in near[i] if d[i, j] <= 0.01}
    assert got == want


def test_empty(spark):
    assert neighbours.near_pairs(table(spark, []), "cell_id", "x_pca", 4, 0.1).count() == 0


def test_greedy_search(spark):
    x = blobs(np.random.default_rng(2))
    df = table(spark, x)
    got = neighbours.search(df, df.where("cell_id % 20 = 0").selectExpr("cell_id as id"), "cell_id", "x_pca", 4, k=5, graph_k=8).collect()
    _, want = knn(x, 5)
    assert len(got) == 5 * 23
    assert sum(r["dst"] in want[r["src"]] for r in got) / len(got) >= 0.95


def test_groups_of_anchors(spark):
    x = blobs(np.random.default_rng(3))
    anchors = spark.createDataFrame([(7, [0.0] * 4), (8, [8.0] * 4), (9, [100.0] * 4), (10, None)], "anchor_id long, x_pca array<float>")
    got = {(r["cell_id"], r["anchor_id"]) for r in density.groups_of_anchors(table(spark, x, BAD[:3]), anchors, 4, 2.0).collect()}
    assert got == {(i, 7) for i in range(200)} | {(i, 8) for i in range(200, 350)}


@pytest.mark.parametrize("in_one_task", [0, 200_000])
def test_spanning_forest_is_minimal(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(communities, "IN_ONE_TASK", in_one_task)
    x = np.random.default_rng(4).normal(0, 1, (60, 4)).astype(np.float32)
    forest, comp = density.spanning_forest(table(spark, x), "cell_id", "x_pca", 4, 100.0, leaf=100)
    e = forest.collect()
    d = np.sqrt(knn(x, 1)[0])
    inside, out, total = {0}, set(range(1, 60)), 0.0
    while out:
        w, j = min((d[i, j], j) for i in inside for j in out)
        total, inside, out = total + w, inside | {j}, out - {j}
    assert len(e) == 59 and abs(sum(r["w"] for r in e) - total) < 1e-3
    assert comp.select("component").distinct().count() == 1


def test_clusters(spark):
    x = blobs(np.random.default_rng(5))
    got = density.cluster(table(spark, x, BAD), "cell_id", "x_pca", 4, 4.0, min_cluster_size=40).collect()
    assert sorted(r["size"] for r in got) == [100, 150, 200]
    assert all(1 <= len(r["exemplars"]) <= 3 for r in got)


def components(comp):
    out = {}
    for r in comp.collect():
        out.setdefault(r["component"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


def test_forest_with_very_many_copies(spark):
    x = np.zeros((1600, 4), np.float32)
    x[1500:] = np.arange(100)[:, None] * np.float32(0.4) + np.float32(0.4)  # a chain that starts at the copies
    for min_samples, n in ((2, 1600), (5, 1501)):  # the chain's further vectors have no core distance within the radius
        forest, comp = density.spanning_forest(table(spark, x, BAD[:3]), "cell_id", "x_pca", 4, 1.0, min_samples)
        assert forest.count() == n - 1 and components(comp) == [list(range(n))]
    alone = density.spanning_forest(table(spark, x[:1500]), "cell_id", "x_pca", 4, 1.0)[1]
    assert components(alone) == [list(range(1500))]


def test_dense_groups_joined_by_one_pair(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.01, (40, 4)), rng.normal(0, 0.01, (40, 4)) + 0.4]).astype(np.float32)
    forest, comp = density.spanning_forest(table(spark, x), "cell_id", "x_pca", 4, 1.0)
    assert forest.count() == 79 and components(comp) == [list(range(80))]


def test_leaf_forest_is_minimal():
    x = np.random.default_rng(7).normal(0, 1, (90, 3)).astype(np.float32)
    i, j, d2 = density.leaf_forest(x, 0.6)
    d = knn(x, 1)[0]
    a, b = np.nonzero(np.triu(d <= 0.6, 1))
    o = np.argsort(d[a, b])
    kept = density.local_forest(a[o], b[o], np.ones(90, bool), 90)[1]
    assert len(i) == len(kept) and abs(d2.sum() - d[a, b][o][kept].sum()) < 1e-9


def test_search_with_very_many_copies(spark):
    x = np.random.default_rng(8).normal(0, 1, (160, 4)).astype(np.float32)
    x[40:100] = x[40]
    bad = [(9100 + i, [float("nan")] * 4, "c") for i in range(40)]
    df = table(spark, x, bad)
    ids = df.where("cell_id % 5 = 0").selectExpr("cell_id as id")
    got = {}
    for r in neighbours.search(df, ids, "cell_id", "x_pca", 4, k=5).collect():
        got.setdefault(r["src"], {})[r["rank"]] = (r["dst"], r["d2"])
    d, near = knn(x, 5)
    assert set(got) == set(range(0, 160, 5))
    for q in range(0, 160, 5):
        assert [got[q][n + 1][0] for n in range(5)] == near[q]
        assert np.allclose([got[q][n + 1][1] for n in range(5)], d[q, near[q]])


def test_invalid_and_repeated_rows_are_no_copies(spark):
    x = np.random.default_rng(9).normal(0, 1, (20, 4)).astype(np.float32)
    x[1] = x[0]
    bad = [(9100 + i, v, "c") for i, v in enumerate([[]] * 40 + [[float("nan")] * 4] * 40)]
    again = [(0, [float(v) for v in x[0]], "c")] * 40
    got = neighbours.near_pairs(table(spark, x, bad + again), "cell_id", "x_pca", 4, 1e-6, k=5).collect()
    assert [tuple(r) for r in got] == [(0, 1)]


def condensed_by_hand(edges, n, m, end):
    """(clusters as sets by stability, density at which each vertex came in), from components at every weight anew."""
    eps, came, live, tree = end / 1000, {}, [], []  # live: [members, children, density at which each came in]
    for w in sorted({e[2] for e in edges}):
        label = list(range(n))
        for a, b, x in edges:
            if x <= w:
                la, lb = label[a], label[b]
                label = [la if c == lb else c for c in label]
        parts = {}
        for i, c in enumerate(label):
            parts.setdefault(c, set()).add(i)
        now = []
        for p in parts.values():
            if len(p) < m:
                continue
            inside = [x for x in live if x["in"] <= p]
            if len(inside) == 1:
                node = inside[0]
            else:
                for x in inside:
                    x["own"] = sum(x["at"][i] for i in x["in"]) - len(x["in"]) / (w + eps)
                node = {"in": set(), "kids": inside, "at": {i: 1 / (w + eps) for x in inside for i in x["in"]}}
                node["in"] = {i for x in inside for i in x["in"]}
                tree.append(node)
            for i in p - node["in"]:
                node["at"][i] = 1 / (w + eps)
                came.setdefault(i, 1 / (w + eps))
            node["in"] = set(p)
            now.append(node)
        live = now
    for x in live:
        x["own"] = sum(x["at"].values()) - len(x["in"]) / (end + eps)

    def best(x):
        got = [best(k) for k in x["kids"]]
        low = sum(g[0] for g in got)
        return (x["own"], [x]) if x["own"] >= low else (low, [c for g in got for c in g[1]])

    return [c for x in live for c in best(x)[1]], came


def nested(rng):
    """Two dense knots inside a wide cloud, a second cloud, and stray points."""
    return np.concatenate([rng.normal(0, 0.05, (60, 3)), rng.normal(0, 0.05, (50, 3)) + [0.7, 0, 0], rng.normal(0, 0.8, (120, 3)), rng.normal(0, 0.6, (90, 3)) + [9, 0, 0], rng.uniform(-4, 12, (30, 3))]).astype(np.float32)


@pytest.mark.parametrize("most_edges", [60, 200_000])
def test_condensed_hierarchy_is_exact(spark, monkeypatch, most_edges):
    monkeypatch.setattr(communities, "IN_ONE_TASK", min(most_edges, 100))
    x = nested(np.random.default_rng(10))
    s = Scratch(spark, "test")
    forest, _ = density.spanning_forest(table(spark, x), "cell_id", "x_pca", 3, 3.0, min_samples=4, leaf=500)
    edges = [(r["a"], r["b"], r["w"]) for r in forest.collect()]
    want, came = condensed_by_hand(edges, len(x), 15, 3.0)
    clusters, members = density.condensed(s, forest, 15, 3.0, most_edges)
    got = {}
    for r in members.collect():
        got.setdefault(r["cluster"], {})[r["id"]] = r["persistence"]
    assert sorted(map(sorted, got.values())) == sorted(sorted(c["in"]) for c in want) and len(want) >= 3
    assert all(abs(came[i] - p) < 1e-9 for c in got.values() for i, p in c.items())
    own = {r["cluster"]: (r["size"], r["stability"]) for r in clusters.collect()}
    assert sorted((n, round(v, 6)) for n, v in own.values()) == sorted((len(c["in"]), round(c["own"], 6)) for c in want)


def test_hierarchy_of_equal_weights(spark):
    """More edges of one weight than a task takes: one event."""
    e = spark.createDataFrame([(0, i, 0.5) for i in range(1, 80)] + [(100, i, 0.5) for i in range(101, 140)] + [(79, 139, 1.5), (300, 301, 0.5)], "a long, b long, w double")
    for most in (10, 1000):
        s = Scratch(spark, "test")
        nodes, vertices = density.hierarchy(s, e, 20, 2.0, most)
        assert sorted((r["size"], r["parent"] is None) for r in nodes.collect()) == [(40, False), (80, False), (120, True)]
        cut = {}
        for r in density.flat_cut(s, nodes, vertices).collect():
            cut.setdefault(r["component"], set()).add(r["id"])
        assert sorted(map(len, cut.values())) == [2, 120]


def test_rounds_do_not_grow_with_a_component(spark, monkeypatch):
    """What hangs on a large component comes in at once, however many edges that has."""
    calls, connected = [], communities.connected

    def counted(*args):
        calls.append(1)
        assert len(calls) < 20
        return connected(*args)

    monkeypatch.setattr(communities, "connected", counted)
    e = spark.createDataFrame([(0, i, 0.5 + i / 1000) for i in range(1, 400)], "a long, b long, w double")
    nodes, vertices = density.hierarchy(Scratch(spark, "test"), e, 20, 2.0, 20)
    assert [(r["size"], r["parent"]) for r in nodes.collect()] == [(400, None)]
    got = {r["id"]: r["density"] for r in vertices.collect()}
    assert set(got) == set(range(400)) and all(abs(got[i] - 1 / (0.5 + max(i, 19) / 1000 + 0.002)) < 1e-9 for i in got)


def test_chain_of_knots_and_copies(spark):
    rng = np.random.default_rng(11)
    knots = np.concatenate([rng.normal(0, 1e-3, (8, 4)) + [0.9 * i, 0, 0, 0] for i in range(2)])
    got = density.groups_of_anchors(table(spark, knots.astype(np.float32)), spark.createDataFrame([(1, [0.0] * 4)], "anchor_id long, x_pca array<float>"), 4, 1.0)
    assert got.count() == 16
    same = spark.range(3000).selectExpr("id as cell_id", "array(1f, 2f, 3f, 4f) as x_pca")
    got = density.groups_of_anchors(same, spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.5])], "anchor_id long, x_pca array<float>"), 4, 1.0)
    assert got.count() == 3000


def test_recall_of_gaussian_vectors(spark):
    x = np.random.default_rng(12).normal(0, 1, (4000, 15)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, x_pca array<float>")
    q = np.arange(0, 4000, 20)
    d = ((x[q][:, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    d[np.arange(len(q)), q] = np.inf
    want = {(int(i), int(j)) for i, row in zip(q, np.argsort(d, axis=1)[:, :5]) for j in row}
    recall = lambda rounds: len(want & {(r["src"], r["dst"]) for r in neighbours.nn_descent(df, "cell_id", "x_pca", 15, trees=2, leaf=80, rounds=rounds).collect()}) / len(want)
    assert recall(12) >= 0.95 > 0.7 > recall(0)


def test_search_from_outside(spark):
    x = blobs(np.random.default_rng(13))
    x[50:90] = x[50]
    df = table(spark, x, BAD)
    y = x[::15] + np.float32(0.01)
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)] + [(900, None), (901, [1.0])], "id long, v array<float>")
    got = {}
    for r in neighbours.search(df, q, "cell_id", "x_pca", 4).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["d2"]))
    d = np.sort(((y[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2), axis=1)[:, :5]
    assert set(got) == set(range(len(y)))
    assert np.mean([np.allclose([v for _, v in sorted(got[i])], d[i], rtol=1e-4) for i in got]) >= 0.95
