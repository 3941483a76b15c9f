"""Communities of a weighted graph: parallel Louvain moves with a connectivity step, and modularity.

Every move is a join and an aggregation over edges; half of the vertices, by hash, may move in a round, so that
neighbours don't swap. Communities that fall apart are split into their connected parts, as Leiden asks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.operators.forests import local_forest
from mosaiq.operators.vectors import whole
from mosaiq.session import Scratch


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v, w) in both directions, parallel edges and both directions summed; loops count in full. Missing weight is 1."""
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    e = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), w.alias("w")).where("u is not null and v is not null")
    return e.unionAll(e.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.sum("w").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity): sum over communities of L_c / m - resolution (K_c / 2m)^2. labels: id, label."""
    g = undirected(edges)
    lab = labels.select("id", "label")
    j = g.join(lab.toDF("u", "cu"), "u").join(lab.toDF("v", "cv"), "v")
    k = j.groupBy(F.col("cu").alias("c")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w"))).alias("i"))
    t = k.agg(F.sum("k").alias("m2"), F.sum("i").alias("i"), F.sum(F.col("k") * F.col("k")).alias("kk"))
    return t.select((F.coalesce("i", F.lit(0.0)) / F.col("m2") - resolution * F.col("kk") / (F.col("m2") * F.col("m2"))).alias("modularity"))


IN_ONE_TASK = 200_000  # edges that one task finishes, as rounds of joins over so few would only cost time


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: all pairs of a task to (u, p), p being the smallest id of u's component."""
    t = whole(batches)
    if t is not None:
        u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
        ids, inv = np.unique(np.r_[u, v], return_inverse=True)
        label = local_forest(inv[: len(u)], inv[len(u) :], np.ones(len(ids), bool), len(ids))[0]
        low = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low[label])], ["u", "p"])


def connected(s: Scratch, pairs: DataFrame) -> DataFrame:
    """(id, root): connected components of pairs (u, v), the root being the smallest id. Ids without pairs aren't listed.

    Each round hooks every id to its smallest neighbour and contracts; what is left when few pairs are is done in one task.
    """
    e = s.put(pairs.select("u", "v").where("u <> v").distinct(), "pairs")
    out = None
    while n := e.count():
        if n <= IN_ONE_TASK:
            p = s.put(e.coalesce(1).mapInArrow(_components, "u long, p long"), "hooks")
        else:
            both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            p = s.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "hooks")
            while True:  # pointers to roots
                nxt = s.put(p.join(p.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p", "left").select("u", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "hooks")
                s.drop(p)
                p, done = nxt, nxt.where("moved").isEmpty()
                if done:
                    break
        p = p.select("u", "p")
        new = p.toDF("id", "root") if out is None else s.put(out.join(p.toDF("root", "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root")), "roots")
        s.drop(out)
        out = new
        if n <= IN_ONE_TASK:
            break
        left = s.put(e.join(p.toDF("u", "pu"), "u").join(p.toDF("v", "pv"), "v").select(F.col("pu").alias("u"), F.col("pv").alias("v")).where("u <> v").distinct(), "pairs")
        s.drop(e)
        e = left
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")) if out is None else out


def leiden(edges: DataFrame, resolution: float = 1.0, rounds: int = 8, levels: int = 3, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """(id, community): modularity communities of the graph; community is the smallest id in it.

    Vertices without edges aren't listed. Deterministic for a seed. An empty graph gives no rows.
    """
    s = scratch or Scratch(edges.sparkSession, "leiden")
    g = s.put(undirected(edges), "graph")
    total = g.agg(F.sum("w")).first()[0]
    member = s.put(g.select(F.col("u").alias("id")).distinct().withColumn("c", F.col("id")), "members")
    if not total:
        return member.select("id", F.col("c").alias("community"))
    for level in range(levels):
        deg = s.put(g.groupBy("u").agg(F.sum("w").alias("k")), "degrees")
        lab = s.put(deg.select("u", F.col("u").alias("c")), "labels")
        for r in range(rounds):
            size = deg.join(lab, "u").groupBy("c").agg(F.sum("k").alias("kc"))
            to = g.where("u <> v").join(lab.toDF("v", "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
            own = lab.withColumn("own", F.lit(True))
            opt = to.join(own, ["u", "c"], "full").join(deg, "u").join(size, "c")
            gain = F.coalesce("w", F.lit(0.0)) - resolution * F.col("k") * (F.col("kc") - F.when(F.col("own"), F.col("k")).otherwise(0.0)) / total
            best = opt.groupBy("u").agg(F.max(F.struct(gain.alias("g"), F.coalesce("own", F.lit(False)).alias("own"), (-F.col("c")).alias("c"))).alias("b"))
            may = F.pmod(F.xxhash64("u", F.lit(seed + r)), F.lit(2)) == 0
            nxt = s.put(lab.join(best, "u", "left").select("u", F.when(may & ~F.coalesce(F.col("b.own"), F.lit(True)), -F.col("b.c")).otherwise(F.col("c")).alias("c"), F.col("c").alias("was")), "labels")
            moved = nxt.where("c <> was").limit(1).count()
            s.drop(lab)
            lab = nxt.select("u", "c")
            if not moved and r:
                break
        inner = g.join(lab.toDF("u", "cu"), "u").join(lab.toDF("v", "cv"), "v").where("cu = cv").select("u", "v")
        root = connected(s, inner)
        lab = s.put(lab.join(root.toDF("u", "root"), "u", "left").select("u", F.coalesce("root", "u").alias("c")), "labels")
        member = s.put(member.withColumnRenamed("c", "u").join(lab, "u").select("id", "c"), "members")
        smaller = g.join(lab.toDF("u", "cu"), "u").join(lab.toDF("v", "cv"), "v").groupBy("cu", "cv").agg(F.sum("w").alias("w")).toDF("u", "v", "w")
        g = s.put(smaller, "graph")
        if lab.where("u <> c").limit(1).count() == 0:
            break
    low = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(low, "c").select("id", "community")


def choose_resolution(value: float | None = None, index: int | None = None, n: int = 50) -> float:
    """A resolution by value, else by index of the grid of n values, else the middle one of the grid."""
    from mosaiq.functions.grids import resolution_values

    return value if value is not None else resolution_values(n)[n // 2 if index is None else index]


def leiden_sections(edges: DataFrame, cells: DataFrame, resolutions: list[float], seed: int = 42) -> DataFrame:
    """(config_id, section, cell_id, label) for each resolution: communities numbered from 0 by size, the largest first.

    Cells (section, cell_id) without edges are communities of one, numbered behind the others in order of their ids.
    """
    from mosaiq.functions.grids import resolution_dirname
    from mosaiq.operators.ordered import rank

    s, out = Scratch(edges.sparkSession, "leiden"), None
    for r in resolutions:
        c = leiden(edges, r, seed=seed, scratch=s)
        all_ = s.put(cells.select("section", "cell_id").join(c.withColumnRenamed("id", "cell_id"), "cell_id", "left").withColumn("community", F.coalesce("community", "cell_id")), "cells")
        size = all_.groupBy("community").agg((-F.count("*")).alias("size")).withColumn("_all", F.lit(0))
        label = rank(s, size, ["_all"], ["size", "community"], "label").select("community", F.col("label").cast("int").alias("label"))
        one = all_.join(label, "community").select(resolution_dirname(F.lit(float(r))).alias("config_id"), "section", "cell_id", "label")
        out = one if out is None else out.unionByName(one)
    return out
