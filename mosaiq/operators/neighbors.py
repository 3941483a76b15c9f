"""Exact spatial neighbour searches per section, on a grid as fine as the points are dense.

A section's square is halved into ever finer grids. Each query is worked on at the finest level whose cell around it
holds enough weight; it meets the points of 3x3 cells there. Those of which nothing outside can matter are done, the
rest goes some levels up. So dense places are settled on small cells, and only sparse ones see large ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators.vectors import whole
from mosaiq.session import Scratch

FINEST = 20  # levels of halving, at most
QUERIES_AT_ONCE = 20_000  # queries of one cell that a task takes; further ones go to others, with the same candidates
PAIRS_AT_ONCE = 2_000_000
LEAST_AROUND = 64.0  # cells that hold less than half of this weight aren't worth a step of their own
TASK_ROWS = 100_000  # queries and candidates of a task, on average

# A kernel's answer for a block of queries: columns of the result, and which queries are done.
Answer = Callable[[dict, dict, np.ndarray], tuple[dict, np.ndarray]]


def search(s: Scratch, points: DataFrame, queries: DataFrame, schema: str, extra: tuple[str, ...], answer: Answer, by: tuple[str, ...] = ("section",)) -> DataFrame:
    """What ``answer`` says for every query, from the points around it.

    points: by, id, x, y, weight, extra; queries: by, id, x, y, need (the weight around that decides), extra, which are
    longs; ids are unique. ``answer`` gets the columns of a block of queries, of their candidates, and all squared distances.
    Queries also have ``edge``, the distance within which all points are among the candidates (infinite if these are
    all), ``sec``, the xxhash64 of by, and ``tile``, which names a few dozen grid cells that lie together.
    Tables of grid cells grow with the points but look small to Spark, as explode counts for nothing in its estimates: their
    joins are by merge, else the driver would have to broadcast them.
    """
    by, own = list(by), ["id", "x", "y", *extra]
    stat = points.groupBy(*by).agg(F.sum("weight").alias("total"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    stat = stat.join(queries.groupBy(*by).agg(F.min("need").alias("least")), by)
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(1e-9)) * (1 + 1e-9)
    deep = F.ceil(F.log2(F.greatest(F.col("total") / F.greatest("least", F.lit(LEAST_AROUND)), F.lit(1.0))) / 2) + 3
    stat = s.put(stat.select(*by, "x0", "y0", span.alias("span"), F.least(deep, F.lit(FINEST)).cast("int").alias("deep")), "squares")
    fine = lambda c, c0: F.floor((F.col(c) - F.col(c0)) / F.col("span") * F.pow(F.lit(2.0), "deep")).cast("long")
    at = lambda df: df.join(stat, by).withColumn("fx", fine("x", "x0")).withColumn("fy", fine("y", "y0"))
    up = lambda c, level: F.expr(f"shiftright({c}, deep - {level})")
    p = s.put(at(points).select(*by, *own, "weight", "fx", "fy"), "points")
    cells = s.put(p.groupBy(*by, "fx", "fy").agg(F.sum("weight").alias("w")).join(stat.select(*by, "deep"), by), "cells")
    # weight around each fine cell, by level
    lev = cells.select(*by, "fx", "fy", "w", "deep", F.explode(F.sequence(F.lit(0), F.col("deep"))).alias("level"))
    lev = lev.withColumn("gx", up("fx", "level")).withColumn("gy", up("fy", "level"))
    sums = lev.groupBy(*by, "level", "gx", "gy").agg(F.sum("w").alias("w")).hint("merge")
    held = lev.drop("w").join(sums, [*by, "level", "gx", "gy"]).groupBy(*by, "fx", "fy").agg(F.array_sort(F.collect_list(F.struct("level", "w"))).alias("held"))
    q = at(queries).join(held.hint("merge"), [*by, "fx", "fy"], "left")
    level = F.greatest(F.size(F.filter("held", lambda h: h["w"] * 2.0 >= F.greatest(F.col("need"), F.lit(LEAST_AROUND)))) - 1, F.lit(0))
    open_ = s.put(q.select(*by, *own, "need", "x0", "y0", "span", "deep", "fx", "fy", F.when(F.col("held").isNull(), 0).otherwise(level).alias("level")), "open")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    key = F.xxhash64(*by, "level", "gx", "gy", "salt")
    sec = F.xxhash64(*by)
    done, up_by = [], 0
    while n_open := open_.count():
        up_by += 1  # sparse places take ever larger steps
        o = open_.withColumn("gx", up("fx", "level")).withColumn("gy", up("fy", "level"))
        qc = o.groupBy(*by, "level", "gx", "gy").agg(F.ceil(F.count("*") / QUERIES_AT_ONCE).cast("int").alias("salts"), F.first("deep").alias("deep"))
        # fine cells that each query cell looks at
        look = qc.withColumn("o", F.explode(around)).select(*by, "level", F.col("gx").alias("tx"), F.col("gy").alias("ty"), "salts", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"))
        seen = lev.select(*by, "fx", "fy", "level", "gx", "gy").join(look.hint("merge"), [*by, "level", "gx", "gy"])
        seen = seen.select(*by, "fx", "fy", "level", F.col("tx").alias("gx"), F.col("ty").alias("gy"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        null = F.lit(None).cast("double")
        cand = p.join(seen.hint("merge"), [*by, "fx", "fy"]).select(key.alias("h"), sec.alias("sec"), F.lit(False).alias("query"), *own, F.col("weight").cast("double").alias("need"), null.alias("edge"), F.lit(0).cast("long").alias("tile"))
        side = F.col("span") / F.pow(F.lit(2.0), "level")
        far = lambda c, c0, g: F.least(F.col(c) - F.col(c0) - (F.col(g) - 1) * side, (F.col(g) + 2) * side - (F.col(c) - F.col(c0)))
        edge = F.when(F.col("level") == 0, F.lit(float("inf"))).otherwise(F.least(far("x", "x0", "gx"), far("y", "y0", "gy")) * (1 - 1e-9))
        ask = o.join(qc.select(*by, "level", "gx", "gy", "salts").hint("merge"), [*by, "level", "gx", "gy"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        tile = F.xxhash64(*by, "level", F.shiftright("gx", 3), F.shiftright("gy", 3))
        ask = ask.select(key.alias("h"), sec.alias("sec"), F.lit(True).alias("query"), *own, F.col("need").cast("double").alias("need"), edge.alias("edge"), tile.alias("tile"))
        parts = max(8, -(-n_open * 4 // TASK_ROWS))
        got = ask.unionByName(cand).repartition(parts, "h").mapInArrow(_meet(own, answer), f"done boolean, id long, {schema}")
        got = s.put(got, "round")
        done.append(got.where("done and id is null").drop("done", "id"))
        nxt = s.put(open_.join(got.where("not done").select("id").hint("merge"), "id", "left_semi").withColumn("level", F.greatest(F.col("level") - up_by, F.lit(0))), "open")
        s.drop(open_)
        open_ = nxt
    if not done:
        return points.sparkSession.createDataFrame([], schema)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _meet(own: list[str], answer: Answer):
    """Kernel: queries and candidates of whole grid cells to answers and to the ids of queries that aren't done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        c = {n: t.column(n).to_numpy() for n in ("h", "sec", "query", *own, "need", "edge", "tile")}
        order = np.lexsort((c["id"], ~c["query"], c["sec"], c["h"]))
        c = {n: a[order] for n, a in c.items()}
        cuts = np.flatnonzero(np.r_[True, (c["h"][1:] != c["h"][:-1]) | (c["sec"][1:] != c["sec"][:-1]), True])
        parts, left = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            m = a + int(np.count_nonzero(c["query"][a:b]))
            if m == a:
                continue
            cand = {n: c[n][m:b] for n in own} | {"weight": c["need"][m:b]}
            step = max(1, PAIRS_AT_ONCE // max(b - m, 1))
            for lo in range(a, m, step):
                hi = min(m, lo + step)
                q = {n: c[n][lo:hi] for n in (*own, "need", "edge", "sec", "tile")}
                dx, dy = q["x"][:, None] - cand["x"][None], q["y"][:, None] - cand["y"][None]
                out, ok = answer(q, cand, dx * dx + dy * dy)
                parts.append(out)
                left.append(q["id"][~ok])
        if not parts:
            return
        out = {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}
        n = len(next(iter(out.values())))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), pa.nulls(n, pa.int64()), *map(pa.array, out.values())], ["done", "id", *out])
        left = np.concatenate(left)
        empty = [pa.nulls(len(left), pa.array(v[:0]).type) for v in out.values()]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(left), bool)), pa.array(left), *empty], ["done", "id", *out])

    return run


def ranked(q: dict, cand: dict, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, rank, done): the k nearest other candidates of each query of a block, those of the queries that are done.

    Ties go to the smaller id. A query is done if its k-th is surely nearer than anything that isn't a candidate, or if
    all points are.
    """
    d = np.where(q["id"][:, None] == cand["id"][None], np.inf, d2)
    ok = np.isinf(q["edge"])
    if d.shape[1] > k:
        kth = np.partition(d, k - 1, axis=1)[:, k - 1]
        ok = ok | (kth < q["edge"] ** 2)
        i, j = np.nonzero((d <= kth[:, None]) & np.isfinite(d) & ok[:, None])
    else:
        i, j = np.nonzero(np.isfinite(d) & ok[:, None])
    order = np.lexsort((cand["id"][j], d[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
    keep = rank <= k
    return i[keep], j[keep], rank[keep], ok


def as_points(df: DataFrame, *more: Column, id_col: str = "cell_id") -> DataFrame:
    return df.select("section", F.col(id_col).cast("long").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *more)


def candidates(points: DataFrame, k: int) -> DataFrame:
    """Of points at one place the k + 1 smallest ids, as no more can be among anyone's k nearest."""
    w = W.partitionBy("section", "x", "y").orderBy("cell_id")
    return points.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).drop("_n")


def sections_of(points: DataFrame) -> DataFrame:
    """(sec, section): names of the hashes that a search works with; one row per section."""
    return points.select("section").distinct().select(F.xxhash64("section").alias("sec"), "section")


def spatial_knn(points: DataFrame, k: int, with_self: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """(section, src, dst, k, d2): the k nearest others (with_self: including itself) of each point in its section.

    Input: section, cell_id, x, y without nulls, ids unique. Ties go to the smaller id; the point itself comes first.
    Sections with fewer points give fewer neighbours.
    """
    s = scratch or Scratch(points.sparkSession, "knn")
    p = s.put(points.select("section", "cell_id", "x", "y"), "all")
    others = k - 1 if with_self else k

    def answer(q: dict, cand: dict, d2: np.ndarray) -> tuple[dict, np.ndarray]:
        if others:
            i, j, rank, ok = ranked(q, cand, d2, others)
        else:
            i, j, rank, ok = np.empty(0, int), np.empty(0, int), np.empty(0, int), np.ones(len(q["id"]), bool)
        src, dst, d = q["id"][i], cand["id"][j], d2[i, j]
        sec = q["sec"][i]
        if with_self:
            me = q["id"][ok]
            src, dst, d, rank, sec = np.r_[me, src], np.r_[me, dst], np.r_[np.zeros(len(me)), d], np.r_[np.ones(len(me), int), rank + 1], np.r_[q["sec"][ok], sec]
        return {"src": src, "dst": dst, "k": rank.astype(np.int32), "d2": d, "sec": sec}, ok

    pts = as_points(candidates(p, k), F.lit(1).cast("long").alias("weight"))
    out = search(s, pts, as_points(p, F.lit(float(k)).alias("need")), "src long, dst long, k int, d2 double, sec long", (), answer)
    return out.join(sections_of(p), "sec").select("section", "src", "dst", "k", "d2")
