import hashlib
import math
from datetime import datetime

import numpy as np
import pytest

from mosaiq.operators import neighbors, percolation, spatial
from mosaiq.session import Scratch


def cells(spark, rows):
    return spark.createDataFrame(rows, "section string, cell_id long, x double, y double, exported_at timestamp, gx int")


def test_positions(spark):
    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    rows = [("a", 1, 1.0, 1.0, t1, 0), ("a", 1, 2.0, 2.0, t2, 0), ("a", 1, 2.0, 2.0, t2, 0), ("b", 2, 0.001, 0.002, t1, 0), (None, 3, 1.0, 1.0, t1, 0), ("a", 4, float("nan"), 1.0, t1, 0), ("a", 5, 0.0, 0.0, t1, 0), ("a", 6, None, 1.0, t1, 0), ("z", 7, 5.0, 5.0, None, 0), (None, None, None, None, None, None)]
    sections = spark.createDataFrame([("a", "um"), ("b", "MM"), (None, "mm")], "section string, xy_unit string")
    got = {(r["section"], r["cell_id"], r["x"], r["y"]) for r in spatial.positions(cells(spark, rows), sections).collect()}
    assert got == {("a", 1, 2.0, 2.0), ("b", 2, 1.0, 2.0), ("z", 7, 5.0, 5.0)}
    assert spatial.positions(cells(spark, []), sections).count() == 0


def test_near_pairs_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = [(f"s{i % 2}", i, float(x), float(y)) for i, (x, y) in enumerate(np.round(rng.uniform(-20, 20, (300, 2)), 1))] + [("s0", 1000 + i, 3.0, 3.0) for i in range(5)]
    df = spark.createDataFrame(pts, "section string, cell_id long, x double, y double")
    want = {(a[1], b[1]) for a in pts for b in pts if a[0] == b[0] and a[1] < b[1] and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 4.0}
    assert {(r["id_1"], r["id_2"]) for r in spatial.near_pairs(df, 2.0).collect()} == want


def inside(px, py, xs, ys):
    n, odd = len(xs), False
    for i in range(n):
        x1, y1, x2, y2 = xs[i], ys[i], xs[(i + 1) % n], ys[(i + 1) % n]
        cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
        if cross == 0 and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
            return True
        if (y1 <= py) != (y2 <= py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def test_points_in_regions(spark):
    shapes = {
        10: ([0, 10, 10, 0], [0, 0, 10, 10]),
        11: ([0, 10, 5, 10, 0, 0], [0, 0, 5, 10, 10, 0]),  # concave, closed
        12: ([2, 2, 8], [2, 8, 5]),
        13: ([0, 1], [0, 1]),
        14: ([0, float("nan"), 3], [0, 1, 2]),
    }
    regions = [(k, "s", [float(v) for v in xs], [float(v) for v in ys]) for k, (xs, ys) in shapes.items()]
    regions += [regions[0], (15, None, [0.0, 1.0, 2.0], [0.0, 2.0, 0.0]), (16, "s", None, None), (17, "s", [], []), (18, "t", [0.0, 9.0, 9.0], [0.0, 0.0, 9.0])]
    r = spark.createDataFrame(regions, "region_id long, section string, xs array<double>, ys array<double>")
    pts = [("s", i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(-2, 23) for y in range(-2, 23))]
    p = spark.createDataFrame(pts, "section string, cell_id long, x double, y double")
    want = {(i, k) for _, i, x, y in pts for k in (10, 11, 12) if inside(x, y, *shapes[k])}
    assert {(q["cell_id"], q["region_id"]) for q in spatial.points_in_regions(p, r, strip=3.0).collect()} == want


def test_knn_brute_force(spark):
    rng = np.random.default_rng(2)
    xy = np.r_[rng.normal(0, 1, (150, 2)), rng.uniform(-100, 100, (50, 2)), np.zeros((6, 2))]
    pts = [("s", i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [("one", 900, 1.0, 1.0), ("two", 901, 0.0, 0.0), ("two", 902, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "section string, cell_id long, x double, y double")
    got = {(r["src"], r["k"]): r["dst"] for r in neighbors.spatial_knn(df, 4).collect()}
    want = {}
    for a in pts:
        o = sorted(((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, b[1]) for b in pts if b[0] == a[0] and b[1] != a[1])[:4]
        want |= {(a[1], k + 1): b for k, (_, b) in enumerate(o)}
    assert got == want


def test_knn_with_self_and_many_at_one_place(spark):
    pts = [("s", i, 5.0, 5.0) for i in range(300)] + [("s", 300 + i, 5.0 + i, 5.0) for i in range(1, 40)] + [("t", 900, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "section string, cell_id long, x double, y double")
    got = {}
    for r in neighbors.spatial_knn(df, 4, True).collect():
        got.setdefault(r["src"], {})[r["k"]] = r["dst"]
    assert got[0] == {1: 0, 2: 1, 3: 2, 4: 3} and got[299] == {1: 299, 2: 0, 3: 1, 4: 2} and got[900] == {1: 900}
    assert got[301] == {1: 301, 2: 0, 3: 1, 4: 2} and len(got) == 340
    assert neighbors.spatial_knn(df.where("false"), 4).count() == 0


def typed(rng, n, types="abc", section="s", start=0):
    xy = rng.normal(0, 1, (n, 2))
    return [(section, start + i, float(x), float(y), types[int((x + rng.normal(0, 0.5)) > 0)] if i % 7 else (None if i % 14 else types[-1])) for i, (x, y) in enumerate(xy)]


POINTS = "section string, cell_id long, x double, y double, type string"


def merged(n, edges, limit):
    label = {i: i for i in n}
    for u, v, p in edges:
        if limit(p) and label[u] != label[v]:
            old, new = label[v], label[u]
            label = {i: new if x == old else x for i, x in label.items()}
    out = {}
    for i, c in label.items():
        out.setdefault(c, []).append(i)
    return list(out.values())


def by_hand(pts, k):
    """Curve of one section: local and macroscopic edges, by the definitions."""
    ids, ty = [p[1] for p in pts], {p[1]: p[4] for p in pts}
    known = [p for p in pts if p[4] is not None]
    f = {t: sum(p[4] == t for p in known) / len(known) for t in {p[4] for p in known}}
    same = {}
    for a in pts:
        o = sorted(((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, b[1]) for b in pts if b[1] != a[1])[:k]
        for r, (_, b) in enumerate(o):
            if ty[a[1]] is not None and ty[b] == ty[a[1]]:
                same.setdefault(r + 1, []).append((hashlib.md5(f"42|{a[1]}|{b}".encode()).hexdigest(), a[1], b))
    edges = [(u, v, 1 - math.exp(-(r - 1 + i / len(block)) * f[ty[u]])) for r, block in same.items() for i, (_, u, v) in enumerate(sorted(block))]
    at = {p[1]: (p[2], p[3]) for p in pts}
    zones = [(min(z), ty[z[0]], len(z), np.mean([at[i] for i in z], axis=0)) for z in merged([p[1] for p in known], edges, lambda p: True)]
    reach = {}
    for z, t, n, c in zones:
        o = sorted((((c - d) ** 2).sum(), y, m, u) for y, u, m, d in zones if y != z)
        total = 0
        for _, y, m, u in o:
            total += m
            if u == t:
                reach[frozenset((z, y))] = min(total, reach.get(frozenset((z, y)), 10**9))
    macro = [(*sorted(pair), 1 - math.exp(-max(1, n) * f[ty[min(pair)]])) for pair, n in reach.items()]
    curve = []
    for step in range(1, 100):
        sizes = map(len, merged(ids, edges + macro, lambda p: 0.01 < p <= (step + 1) / 100))
        curve.append(-sum(s / len(ids) * math.log2(s / len(ids)) for s in sizes))
    return edges, macro, curve


def test_groups_larger_than_a_task(spark):
    rng = np.random.default_rng(8)
    rows = [(1, v, t, *map(int, sorted(rng.choice(40, 2, False) + 100 * t)), int(rng.integers(0, 6))) for v in (0, 1) for t in (1, 2) for _ in range(25)]
    e = spark.createDataFrame(rows, "sec long, variant byte, t long, src long, dst long, step int")
    s = Scratch(spark, "test")
    sums = [{(r["variant"], r["t"], r["step"]): round(r["s"], 9) for r in percolation.entropy_sums(s, e, 5, most).collect()} for most in (3, 1000)]
    zones = [{(r["variant"], r["cell_id"], r["zone"]) for r in percolation.zone_labels(s, e, most).collect()} for most in (3, 1000)]
    assert sums[0] == sums[1] and len(sums[0]) == 16 and zones[0] == zones[1] and len(zones[0]) > 50


def test_score_brute_force(spark):
    rng = np.random.default_rng(6)
    pts = typed(rng, 70)
    df = spark.createDataFrame([*pts, ("alone", 500, 1.0, 2.0, "a")], POINTS)
    edges, macro, real = by_hand(pts, 5)
    assert {(r["src"], r["dst"]): round(r["p"], 9) for r in percolation.activation_edges(df, 5).collect()} == {(u, v): round(p, 9) for u, v, p in edges}
    assert len(macro) > 5
    order = sorted(pts, key=lambda p: (hashlib.md5(f"42|{p[1]}".encode()).hexdigest(), p[1]))
    dealt = [(*p[:4], q[4]) for p, q in zip(sorted(pts, key=lambda p: p[1]), order)]
    assert {r["cell_id"]: r["type"] for r in percolation.permuted_types(df).where("section = 's'").collect()} == {p[1]: p[4] for p in dealt}
    perm = by_hand(dealt, 5)[2]
    got = {(r["section"], r["variant"], r["step"]): r["entropy"] for r in percolation.score_curves(df, 5).collect()}
    assert all(abs(got["s", 0, i + 1] - h) < 1e-9 for i, h in enumerate(real)) and all(abs(got["s", 1, i + 1] - h) < 1e-9 for i, h in enumerate(perm))
    g = [abs(a - b) for a, b in zip(real, perm)]
    score = {r["section"]: r for r in percolation.score_sections(df, 5).collect()}
    assert abs(score["s"]["raw"] - sum((a + b) / 200 for a, b in zip(g, g[1:]))) < 1e-9 and score["alone"]["raw"] == 0 and score["alone"]["normalized"] is None


def test_curves_of_types(spark):
    pts = typed(np.random.default_rng(7), 40)
    df = spark.createDataFrame(pts, POINTS)
    edges = by_hand(pts, 4)[0]
    got = {(r["type"], r["step"]): r["entropy"] for r in percolation.type_entropy_curves(df, 4).collect()}
    for t in ("a", "b"):
        ids = [p[1] for p in pts if p[4] == t]
        for step in (1, 30, 99):
            sizes = map(len, merged(ids, [e for e in edges if e[0] in ids], lambda p: 0.01 < p <= (step + 1) / 100))
            assert abs(got[t, step] + sum(s / len(ids) * math.log2(s / len(ids)) for s in sizes)) < 1e-9
    assert percolation.entropy_curve(df, 4).count() == 99 and percolation.score_sections(df.where("false"), 4).count() == 0


def test_macro_edges_brute_force(spark):
    from mosaiq.operators import neighborhood

    zones = [("s", 0, t, z, n, float(x), float(y)) for t, z, n, x, y in (("a", 1, 4, 0, 0), ("a", 2, 2, 3, 0), ("a", 5, 1, 9, 9), ("b", 7, 6, 1, 0))]
    df = spark.createDataFrame(zones, "section string, variant byte, type string, zone long, size long, x double, y double")
    frac = neighborhood.type_fractions(spark.createDataFrame([("s", t) for t, n in (("a", 7), ("b", 6)) for _ in range(n)], "section string, type string"))
    got = {(r["src"], r["dst"]): r["p"] for r in percolation.macro_edges(df, frac).collect()}
    k = {(1, 2): min(6 + 2, 6 + 4), (2, 5): min(6 + 4 + 1, 2)}  # 1 and 5 are 9 cells apart, which merges in the last step only
    assert set(got) == set(k)
    for pair, n in k.items():
        assert abs(got[pair] - (1 - math.exp(-max(1, n) * 7 / 13))) < 1e-9


def test_edges_of_the_last_step(spark):
    """Zones that never merge as a pair are tied through others, where these merge with both."""
    zones = spark.createDataFrame([("s", 0, t, z) for t, ids in (("a", range(1, 6)), ("b", (10, 11)), ("c", (20, 21, 22))) for z in ids], "section string, variant byte, type string, zone long")
    never = [("a", 1, 2), ("a", 1, 5), ("b", 10, 11), ("c", 20, 22), ("c", 21, 22)]
    macro = spark.createDataFrame([("s", 0, t, a, b, 0.005) for t, a, b in never] + [("s", 0, "a", 2, 3, 0.5)], "section string, variant byte, type string, src long, dst long, p double")
    got = [(r["src"], r["dst"]) for r in percolation.last_edges(Scratch(spark, "test"), zones, macro).collect()]
    assert not {(a, b) for _, a, b in never} & set(got)
    assert sorted(map(sorted, merged([*range(1, 6), 10, 11, 20, 21, 22], [(a, b, 1) for a, b in got], lambda p: True))) == [[1, 2, 3, 4, 5], [10], [11], [20, 21], [22]]


def test_grid_cells_are_never_broadcast(spark, monkeypatch):
    """Tables that explode makes look small to Spark whatever their size, and the driver must not hold them."""
    plans, put = [], Scratch.put

    def watched(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df, name)

    monkeypatch.setattr(Scratch, "put", watched)
    pts = [("s", i, float(i % 20), float(i // 20), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(pts, "section string, cell_id long, x double, y double, type string")
    got = neighbors.spatial_knn(df, 3)
    assert got.count() == 1200
    broadcast = [p for p in plans if "BroadcastHashJoin" in p]
    assert broadcast  # small tables of fixed size may be
    for plan in broadcast:
        depth, inside = None, False
        for line in plan.splitlines():
            at = len(line) - len(line.lstrip(" :+-"))
            if inside and at <= depth:
                inside = False
            if "BroadcastExchange" in line and not inside:
                depth, inside = at, True
            assert not (inside and ("Generate" in line or "collect_list" in line)), plan
