"""Percolation of same-type neighbours: activation, zones, entropy curves and scores.

Components never mix types. Edges are thinned to spanning forests, first among the edges of a tile of a section, then
per (section, type): a forest of minimum step has the same components at every step. Both variants of a section, with
its real and with permuted types, go through the same jobs, as column ``variant`` (0 and 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators import ordered
from mosaiq.operators.communities import connected
from mosaiq.operators.forests import merge_labels, thin
from mosaiq.operators.neighbors import as_points, candidates, ranked, search
from mosaiq.operators.neighborhood import type_fractions
from mosaiq.operators.vectors import whole
from mosaiq.session import Scratch, partitions_for

STEPS = 100
MOST_EDGES = 2_000_000  # forest edges of one type of a section that a task takes; larger ones are swept by joins
TILE_EDGES = 500_000  # edges of a task that thins


def permuted_types(types: DataFrame, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """The null model: types of a section dealt anew among its cells, by order of md5(seed|id)."""
    s = scratch or Scratch(types.sparkSession, "permuted")
    h = types.select("section", "cell_id", "type", F.md5(F.concat(F.lit(f"{seed}|"), F.col("cell_id").cast("string"))).alias("h"))
    a = ordered.rank(s, h.select("section", "cell_id"), ["section"], ["cell_id"], "r")
    b = ordered.rank(s, h, ["section"], ["h", "cell_id"], "r").select("section", "r", "type")
    return a.join(b, ["section", "r"]).select("section", "cell_id", "type")


def _dims(types: DataFrame) -> DataFrame:
    """(sec, t, section, type, fraction): one row per section and type, with the hashes that edges carry."""
    return type_fractions(types).select(F.xxhash64("section").alias("sec"), F.xxhash64("type").alias("t"), "section", "type", "fraction")


def typed_edges(s: Scratch, points: DataFrame, k: int, variants: tuple[str, ...] = ("type",)) -> DataFrame:
    """(sec, variant, t, src, dst, k, tile): those of the k nearest neighbours that have a cell's type, for each type column.

    sec and t are hashes of section and type. Other neighbours never leave the task that finds them.
    """
    code = [F.when(F.col(v).isNotNull(), F.xxhash64(v)).otherwise(F.xxhash64(F.lit("no type"), "cell_id")).alias(f"t{n}") for n, v in enumerate(variants)]
    names = tuple(f"t{n}" for n in range(len(variants)))

    def answer(q: dict, cand: dict, d2: np.ndarray) -> tuple[dict, np.ndarray]:
        i, j, rank, ok = ranked(q, cand, d2, k)
        parts = []
        for n, name in enumerate(names):
            m = q[name][i] == cand[name][j]
            a, b = i[m], j[m]
            parts.append({"sec": q["sec"][a], "variant": np.full(len(a), n, np.int8), "t": q[name][a], "src": q["id"][a], "dst": cand["id"][b], "k": rank[m].astype(np.int32), "tile": q["tile"][a]})
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}, ok

    pts = as_points(candidates(points, k), F.lit(1).cast("long").alias("weight"), *code)
    return search(s, pts, as_points(points, F.lit(float(k)).alias("need"), *code), "sec long, variant byte, t long, src long, dst long, k int, tile long", names, answer)


ACTIVE = "sec long, variant byte, t long, src long, dst long, k int, tile long, p double"
BUCKET_EDGES = 50_000  # edges of one section and rank that are put in order together, on average


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: whole buckets of edges in order of their hash, with the bond probability that follows from their place."""
    t = whole(batches)
    if t is None:
        return
    c = {n: t.column(n).to_numpy() for n in ("sec", "variant", "t", "src", "dst", "k", "tile", "h", "bucket", "base", "block", "fraction")}
    order = np.lexsort((c["dst"], c["src"], c["h"], c["bucket"], c["k"], c["variant"], c["sec"]))
    c = {n: a[order] for n, a in c.items()}
    new = np.zeros(len(order), bool)
    for n in ("sec", "variant", "k", "bucket"):
        new[1:] |= c[n][1:] != c[n][:-1]
    new[:1] = True
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - starts[np.cumsum(new) - 1] + c["base"]
    p = 1.0 - np.exp(-(c["k"] - 1 + place / c["block"]) * c["fraction"])
    names = ["sec", "variant", "t", "src", "dst", "k", "tile"]
    yield pa.RecordBatch.from_arrays([*(pa.array(c[n]) for n in names), pa.array(p)], [*names, "p"])


def _activated(s: Scratch, edges: DataFrame, dims: DataFrame, seed: int) -> DataFrame:
    """Edges of typed_edges with p, the bond probability at which each becomes active.

    The order of a section's edges of one rank is that of a hash, so that buckets of the hash can be counted first and
    then be put in order each in one task.
    """
    md5 = F.md5(F.concat(F.lit(f"{seed}|"), F.col("src").cast("string"), F.lit("|"), F.col("dst").cast("string")))
    key = ["sec", "variant", "k"]
    e = edges.withColumn("h", F.conv(F.substring(md5, 1, 15), 16, 10).cast("long"))  # 60 bits
    rows = edges.count()
    most = edges.groupBy(*key).count().agg(F.max("count")).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(most, 1) / BUCKET_EDGES))))
    e = e.withColumn("bucket", F.shiftright("h", 60 - bits) if bits else F.lit(0).cast("long"))
    n = e.groupBy(*key, "bucket").agg(F.count("*").alias("n"))
    w = W.partitionBy(*key)
    n = s.put(n.select(*key, "bucket", F.coalesce(F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(w).alias("block")), "buckets")
    e = e.join(n, [*key, "bucket"]).join(dims.select("sec", "t", "fraction"), ["sec", "t"])
    return e.repartition(max(8, -(-rows // TILE_EDGES)), *key, "bucket").mapInArrow(_in_order, ACTIVE)


def activation_edges(points: DataFrame, k: int, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """(section, type, src, dst, k, p): same-type edges with the bond probability at which they become active.

    Input: section, cell_id, x, y, type. p = 1 - exp(-(k - 1 + pos / block) f): f is the fraction of the type, pos the
    place of the edge among the section's same-type edges of rank k in order of md5(seed|src|dst).
    """
    s = scratch or Scratch(points.sparkSession, "activation")
    dims = s.put(_dims(points), "dims")
    e = _activated(s, s.put(typed_edges(s, points, k), "typed"), dims, seed)
    return e.join(dims.select("sec", "t", "section", "type"), ["sec", "t"]).select("section", "type", "src", "dst", "k", "p")


def step_of(p: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Step 1..steps-1 of the sweep in which an edge is merged; 0 for p up to the first grid value: these never merge."""
    grid = np.linspace(0, 1, steps + 1)[1:]
    return np.searchsorted(grid, p, "left")


def components(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of each vertex's component, by hooking to the smaller label and doubling."""
    label = np.arange(n)
    while len(u):
        lu, lv = label[u], label[v]
        keep = lu != lv
        if not keep.any():
            break
        u, v, lu, lv = u[keep], v[keep], lu[keep], lv[keep]
        hi, lo = np.maximum(lu, lv), np.minimum(lu, lv)
        parent = np.arange(n)
        np.minimum.at(parent, hi, lo)
        label = merge_labels(parent)[label]
    return label


THIN = "sec long, variant byte, t long, src long, dst long, step int"


def _thin(steps: int):
    """Kernel: the edges of a task to a spanning forest of minimum step. Edges that never merge come last, as step ``steps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        sec, var, ty, src, dst, p = (t.column(c).to_numpy() for c in ("sec", "variant", "t", "src", "dst", "p"))
        step = step_of(p, steps)
        step = np.where((step > 0) & (step < steps), step, steps).astype(np.int32)
        keep = thin(src * 2 + var, dst * 2 + var, step)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sec, var, ty, src, dst, step)], ["sec", "variant", "t", "src", "dst", "step"])

    return run


def thinned(edges: DataFrame, by: str, rows: int, steps: int = STEPS) -> DataFrame:
    """Edges (sec, variant, t, src, dst, step) of spanning forests among the edges that share ``by``, from edges with p.

    All components at every step are kept, and so are those of all edges, as those that never merge have step ``steps``.
    """
    return edges.select("sec", "variant", "t", "src", "dst", "p", by).repartition(max(8, -(-rows // TILE_EDGES)), by).mapInArrow(_thin(steps), THIN)


GROUP = ["sec", "variant", "t"]


def _large(s: Scratch, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of groups that a task takes, and those of larger ones, if there are any."""
    big = s.put(edges.groupBy(*GROUP).count().where(F.col("count") > most).select(*GROUP), "large")
    if big.isEmpty():
        return edges, None
    return edges.join(big, GROUP, "left_anti"), edges.join(big, GROUP, "left_semi")


def _in_tasks(edges: DataFrame, kernel, schema: str) -> DataFrame:
    """The kernel on whole groups, many of them in a task."""
    return edges.repartition(partitions_for(edges.sparkSession, edges.count(), TILE_EDGES), *GROUP).mapInArrow(kernel, schema)


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: all edges of groups to (sec, variant, cell_id, zone)."""
    t = whole(batches)
    if t is None:
        return
    sec, var, src, dst = (t.column(c).to_numpy() for c in ("sec", "variant", "src", "dst"))
    ids, at, inv = np.unique(np.r_[src, dst] * 2 + np.r_[var, var], return_index=True, return_inverse=True)
    label = components(inv[: len(src)], inv[len(src) :], len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[sec, sec][at]), pa.array(np.r_[var, var][at]), pa.array(ids // 2), pa.array(ids[label] // 2)], ["sec", "variant", "cell_id", "zone"])


def zone_labels(s: Scratch, edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(sec, variant, cell_id, zone): components of all edges; zone is the smallest cell id in it.

    Cells without same-type edges aren't listed; they are zones of one.
    """
    small, large = _large(s, edges, most)
    out = _in_tasks(small, _zones, "sec long, variant byte, cell_id long, zone long")
    if large is not None:
        pair = lambda c: (F.col(c) * 2 + F.col("variant"))
        root = connected(s, large.select(pair("src").alias("u"), pair("dst").alias("v")))
        of = large.select(pair("src").alias("id"), "sec", "variant").unionAll(large.select(pair("dst").alias("id"), "sec", "variant")).distinct()
        half = lambda c: F.shiftright(c, 1)
        out = out.unionByName(of.join(root, "id").select("sec", "variant", half("id").alias("cell_id"), half("root").alias("zone")))
    return s.put(out, "zones")


def zone_table(points: DataFrame, zoned: DataFrame, variants: tuple[str, ...] = ("type",)) -> DataFrame:
    """(section, variant, type, zone, size, x, y): size and centroid of each zone, zones of one included."""
    types = F.explode(F.array(*[F.struct(F.lit(n).cast("byte").alias("variant"), F.col(v).alias("type")) for n, v in enumerate(variants)]))
    t = points.select("section", "cell_id", "x", "y", types.alias("_t")).select("section", "cell_id", "x", "y", "_t.*").where("type is not null")
    t = t.join(zoned.select("variant", "cell_id", "zone").hint("merge"), ["variant", "cell_id"], "left")
    return t.groupBy("section", "variant", "type", F.coalesce("zone", "cell_id").alias("zone")).agg(F.count("*").alias("size"), F.avg("x").alias("x"), F.avg("y").alias("y"))


def macro_edges(zone: DataFrame, fractions: DataFrame, steps: int = STEPS, scratch: Scratch | None = None) -> DataFrame:
    """(section, variant, type, src, dst, p): edges between zones of a type that merge before the last step, src < dst being zone ids.

    k(i -> j) is the total size of all zones of the section up to distance d(i, j) from i, without i's own;
    p = 1 - exp(-max(1, min(k_ij, k_ji)) f). Edges of p beyond 1 - 1 / steps all merge in the last
    step and are left out (see last_edges): a zone of a type of fraction f need look no further than at ln(steps) / f cells around it, so that all zones
    of a type look at a few times the section's cells together. Types with one zone have none. Zones at equal distance
    count in order of their ids.
    """
    s = scratch or Scratch(zone.sparkSession, "macro")
    several = zone.groupBy("section", "variant", "type").agg(F.count("*").alias("n")).where("n > 1").select("section", "variant", "type")
    z = s.put(zone.withColumn("t", F.xxhash64("type")), "zones")
    name = F.col("zone") * 2 + F.col("variant")
    pts = z.select("section", "variant", name.alias("id"), "x", "y", F.col("size").alias("weight"), "t")
    need = F.log(F.lit(float(steps))) / F.col("fraction") + 1
    q = z.join(several, ["section", "variant", "type"]).join(fractions.select("section", "type", "fraction"), ["section", "type"])
    q = q.select("section", "variant", name.alias("id"), "x", "y", need.alias("need"), "t")

    def answer(q: dict, cand: dict, d2: np.ndarray) -> tuple[dict, np.ndarray]:
        d = np.where(q["id"][:, None] == cand["id"][None], -1.0, d2)
        order = np.lexsort((np.broadcast_to(cand["id"], d.shape), d))
        d, w, t = np.take_along_axis(d, order, 1), cand["weight"][order], cand["t"][order]
        w[:, 0] = np.where(d[:, 0] < 0, 0, w[:, 0])  # the zone itself
        k = np.cumsum(w, axis=1)
        inside = d < (q["edge"] ** 2)[:, None]
        ok = np.isinf(q["edge"]) | ((k * inside).max(axis=1) >= q["need"])
        i, j = np.nonzero((t == q["t"][:, None]) & (d >= 0) & (k <= q["need"][:, None]) & inside & ok[:, None])
        return {"a": q["id"][i], "b": cand["id"][order[i, j]], "k": k[i, j]}, ok

    found = search(s, pts, q, "a long, b long, k double", ("t",), answer, ("section", "variant"))
    e = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("k").alias("k"))
    of = z.select(name.alias("a"), "section", "variant", "type").join(fractions.select("section", "type", "fraction"), ["section", "type"])
    p = F.lit(1.0) - F.exp(-F.greatest(F.col("k"), F.lit(1.0)) * F.col("fraction"))
    half = lambda c: F.shiftright(c, 1)
    e = e.join(of.hint("merge"), "a").select("section", "variant", "type", half("a").alias("src"), half("b").alias("dst"), p.alias("p"))
    return e.where(F.col("p") <= float(np.linspace(0, 1, steps + 1)[steps - 1]))


def last_edges(s: Scratch, zone: DataFrame, macro: DataFrame, steps: int = STEPS) -> DataFrame:
    """(section, variant, type, src, dst): edges that connect what all macroscopic edges do in the last step.

    In the last step all pairs of zones of a type merge but those of p up to 1 / steps, which never do and are all
    among ``macro``. So a zone is tied to the first of its type; where that pair never merges, to the last one; and
    where that doesn't either, to all with which it merges.
    """
    key = ["section", "variant", "type"]
    z = zone.select(*key, "zone")
    hub = s.put(z.groupBy(*key).agg(F.min("zone").alias("h1"), F.max("zone").alias("h2")).where("h1 < h2"), "hubs")
    never = s.put(macro.where(F.col("p") <= float(np.linspace(0, 1, steps + 1)[1])).select(*key, "src", "dst"), "never")
    pair = lambda df, a, b: df.select(*key, F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "zone", "h1", "h2")
    first = pair(z.join(hub, key).where("zone <> h1"), "zone", "h1")
    tied = first.join(never, [*key, "src", "dst"], "left_anti")
    left = s.put(first.join(never, [*key, "src", "dst"], "left_semi"), "left")
    apart = left.where("zone = h2").select(*key).distinct().withColumn("apart", F.lit(True))  # the hubs themselves never merge
    left = left.join(apart, key, "left").select(*key, "zone", "h1", "h2", F.coalesce("apart", F.lit(False)).alias("apart"))
    second = pair(left.where("not apart"), "zone", "h2")
    tied2 = second.join(never, [*key, "src", "dst"], "left_anti")
    rest = left.where("apart").select(*key, "zone", "h1", "h2").unionByName(second.join(never, [*key, "src", "dst"], "left_semi").select(*key, "zone", "h1", "h2"))
    tied3 = pair(rest.join(z.withColumnRenamed("zone", "other"), key).where("zone <> other"), "zone", "other").join(never, [*key, "src", "dst"], "left_anti")
    return tied.unionByName(tied2).unionByName(tied3).select(*key, "src", "dst").distinct()


def _sweep(steps: int):
    """Kernel: all edges of groups, with steps, to (sec, variant, t, step, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        sec, var, ty, src, dst, step = (t.column(c).to_numpy() for c in ("sec", "variant", "t", "src", "dst", "step"))
        ids, at, inv = np.unique(np.r_[src, dst] * 2 + np.r_[var, var], return_index=True, return_inverse=True)
        n, m = len(ids), len(src)
        of = np.stack([np.r_[sec, sec][at], np.r_[var, var][at].astype(np.int64), np.r_[ty, ty][at]])
        groups, group = np.unique(of, axis=1, return_inverse=True)
        group = group.ravel()
        order = np.argsort(step, kind="stable")
        u, v, step = inv[:m][order], inv[m:][order], step[order]
        cuts = np.searchsorted(step, np.arange(steps + 1))
        label, size = np.arange(n), np.ones(n, np.int64)
        now, out = np.zeros(groups.shape[1]), np.zeros((steps - 1, groups.shape[1]))
        f = lambda x: x * np.log2(np.maximum(x, 1))
        for i in range(1, steps):
            a, b = label[u[cuts[i] : cuts[i + 1]]], label[v[cuts[i] : cuts[i + 1]]]
            keep = a != b
            if keep.any():
                old, inv2 = np.unique(np.r_[a[keep], b[keep]], return_inverse=True)
                k = int(keep.sum())
                lab = components(inv2[:k], inv2[k:], len(old))
                new = np.bincount(lab, size[old], len(old)).astype(np.int64)
                roots = np.flatnonzero(new)
                now += np.bincount(group[old[roots]], f(new[roots]), len(now)) - np.bincount(group[old], f(size[old]), len(now))
                size[old[roots]] = new[roots]
                up = np.arange(n)
                up[old] = old[lab]
                label = up[label]
            out[i - 1] = now
        g = np.tile(np.arange(groups.shape[1]), steps - 1)
        yield pa.RecordBatch.from_arrays([pa.array(groups[0][g]), pa.array(groups[1][g].astype(np.int8)), pa.array(groups[2][g]), pa.array(np.repeat(np.arange(1, steps, dtype=np.int32), groups.shape[1])), pa.array(out.ravel())], ["sec", "variant", "t", "step", "s"])

    return run


SUMS = "sec long, variant byte, t long, step int, s double"


def _sweep_by_joins(s: Scratch, edges: DataFrame, steps: int) -> DataFrame:
    """The sums of groups that fit no task: the components of each step are contracted by joins."""
    pair = lambda c: (F.col(c) * 2 + F.col("variant")).alias(c)
    e = s.put(edges.where((F.col("step") > 0) & (F.col("step") < steps)).select(*GROUP, pair("src"), pair("dst"), "step"), "large")
    of = s.put(e.select(*GROUP, F.col("src").alias("c")).unionAll(e.select(*GROUP, F.col("dst"))).distinct(), "members")
    size = s.put(of.select("c", F.lit(1).cast("long").alias("n")), "sizes")
    f = lambda c: F.col(c) * F.log2(F.col(c))
    gains = []
    for step in sorted(r[0] for r in e.select("step").distinct().collect()):
        root = connected(s, e.where(F.col("step") == step).select(F.col("src").alias("u"), F.col("dst").alias("v"))).toDF("c", "r")
        j = size.join(root, "c", "left")
        new = j.where("r is not null").groupBy("r").agg(F.sum("n").alias("n"), F.sum(f("n")).alias("was"))
        gains.append(s.put(new.join(of.withColumnRenamed("c", "r"), "r").groupBy(*GROUP).agg(F.sum(f("n") - F.col("was")).alias("gain")).withColumn("step", F.lit(step)), "gains"))
        size = s.put(j.where("r is null").select("c", "n").unionByName(new.select(F.col("r").alias("c"), "n")), "sizes")
        left = e.where(F.col("step") > step).join(root.toDF("src", "ru"), "src", "left").join(root.toDF("dst", "rv"), "dst", "left")
        e = s.put(left.select(*GROUP, F.coalesce("ru", "src").alias("src"), F.coalesce("rv", "dst").alias("dst"), "step").where("src <> dst"), "large")
    got = gains[0]
    for g in gains[1:]:
        got = got.unionByName(g)
    at = got.withColumn("at", F.explode(F.sequence(F.col("step"), F.lit(steps - 1)))).groupBy(*GROUP, F.col("at").alias("step")).agg(F.sum("gain").alias("s"))
    every = edges.select(*GROUP).distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    return every.join(at, [*GROUP, "step"], "left").na.fill(0.0, ["s"]).select(*GROUP, F.col("step").cast("int").alias("step"), "s")


def entropy_sums(s: Scratch, edges: DataFrame, steps: int = STEPS, most: int = MOST_EDGES) -> DataFrame:
    """(sec, variant, t, step, s): sum of size x log2(size) of a type's components after each step of the sweep.

    ``edges`` have steps (see thinned); those of step 0 and of ``steps`` and more never merge.
    """
    small, large = _large(s, edges, most)
    out = _in_tasks(small, _sweep(steps), SUMS)
    return out if large is None else out.unionByName(_sweep_by_joins(s, large, steps))


def _curves(points: DataFrame, sums: DataFrame, steps: int) -> DataFrame:
    """(section, variant, step, pbond, entropy, n) for the variants of ``sums``."""
    n = points.groupBy("section").agg(F.count("*").alias("n")).withColumn("sec", F.xxhash64("section"))
    s = sums.groupBy("sec", "variant", "step").agg(F.sum("s").alias("s"))
    base = n.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    return base.join(s, ["sec", "step"], "left").select("section", "variant", "step", (F.col("step") / float(steps)).alias("pbond"), (F.log2("n") - F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("entropy"), "n")


def _local(s: Scratch, points: DataFrame, k: int, variants: tuple[str, ...], seed: int) -> tuple[DataFrame, DataFrame]:
    """Dimensions, and the local edges thinned tile by tile."""
    dims = s.put(_dims(points), "dims")
    e = s.put(typed_edges(s, points, k, variants), "typed")
    return dims, s.put(thinned(_activated(s, e, dims, seed), "tile", e.count()), "thinned")


def entropy_curve(points: DataFrame, k: int, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """(section, step, pbond, entropy, n): component-size entropy of local edges, H = log2 n - sum(s log2 s) / n, after each step.

    n counts the section's cells. pbond is the lower bound of the step's interval. Sections without edges keep log2 n.
    """
    s = scratch or Scratch(points.sparkSession, "curve")
    return _curves(points, entropy_sums(s, _local(s, points, k, ("type",), seed)[1]), STEPS).drop("variant")


def type_entropy_curves(points: DataFrame, k: int, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """(section, type, step, entropy): the same among the cells of each type that has edges."""
    s = scratch or Scratch(points.sparkSession, "curves")
    dims, e = _local(s, points, k, ("type",), seed)
    n = points.where("type is not null").groupBy("section", "type").agg(F.count("*").alias("n"))
    c = entropy_sums(s, e).join(dims.select("sec", "t", "section", "type"), ["sec", "t"]).join(n, ["section", "type"])
    return c.select("section", "type", "step", (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def trapezoid(curves: DataFrame, keys: list[str], x: str, y: str, out: str) -> DataFrame:
    """Integral of y over x per key, by the trapezoid rule. Nulls in y are left out."""
    w = W.partitionBy(*keys).orderBy(x)
    c = curves.where(F.col(y).isNotNull()).withColumn("_d", (F.lead(x).over(w) - F.col(x)) * (F.lead(y).over(w) + F.col(y)) / 2.0)
    return c.groupBy(*keys).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias(out))


def percolation_score(real: DataFrame, perm: DataFrame) -> DataFrame:
    """(section, n, raw, normalized) from two entropy curves: integral of |H_perm - H_real|, and that over log2 n.

    normalized is null for sections of one cell. Curves (section, step, pbond, entropy, n) may be stored ones; steps that
    only one of them has, and entropies that are null or not finite, don't count.
    """
    good = lambda df: df.where(F.col("entropy").isNotNull() & (F.abs("entropy") < float("inf")))
    j = good(real).select("section", "step", "pbond", "n", F.col("entropy").alias("h")).join(good(perm).select("section", "step", F.col("entropy").alias("hp")), ["section", "step"])
    s = trapezoid(j.withColumn("g", F.abs(F.col("hp") - F.col("h"))), ["section", "n"], "pbond", "g", "raw")
    return s.withColumn("normalized", F.when(F.col("n") > 1, F.col("raw") / F.log2("n")))


def score_curves(points: DataFrame, max_k: int, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """(section, variant, step, pbond, entropy, n): entropy curves of local and macroscopic edges, real and permuted.

    Input: section, cell_id, x, y, type. Local edges join the max_k nearest cells of the same type, macroscopic edges the
    zones that these form. A null type never joins, but its cell counts.
    """
    s = scratch or Scratch(points.sparkSession, "percolation")
    p = points.select("section", "cell_id", "x", "y", "type")
    p = s.put(p.join(permuted_types(p, seed, s).select("section", "cell_id", F.col("type").alias("permuted")), ["section", "cell_id"]), "typed")
    both = ("type", "permuted")
    dims, local = _local(s, p, max_k, both, seed)
    zones = s.put(zone_table(p, zone_labels(s, local), both), "zone-table")
    m = s.put(macro_edges(zones, dims, scratch=s), "zone-edges")
    m = m.unionByName(last_edges(s, zones, m).withColumn("p", F.lit(1.0))).join(dims.select("sec", "t", "section", "type"), ["section", "type"])
    m = m.select("sec", "variant", "t", "src", "dst", "p", F.xxhash64("sec", "variant", "t", F.shiftright("src", 16)).alias("block"))
    m = s.put(m, "macro")
    far = thinned(m, "block", m.count())
    curves = s.put(_curves(p, entropy_sums(s, s.put(local.unionByName(far), "all-edges")), STEPS), "curves")
    # a section without any edge has no sums of its own
    alone = curves.where("variant is null").drop("variant").withColumn("variant", F.explode(F.array(F.lit(0).cast("byte"), F.lit(1).cast("byte")))).select(*curves.columns)
    return curves.where("variant is not null").unionByName(alone)


def score_sections(points: DataFrame, max_k: int, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """(section, n, raw, normalized): percolation score of each section against its permuted types (see score_curves)."""
    s = scratch or Scratch(points.sparkSession, "percolation")
    c = s.put(score_curves(points, max_k, seed, s), "score-curves")
    return percolation_score(c.where("variant = 0"), c.where("variant = 1"))
