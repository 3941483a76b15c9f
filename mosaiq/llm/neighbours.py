"""The k most similar vectors of every vector: NN-descent as Spark joins, and greedy search in its graph.

A row of the working graph belongs to a *pivot* and is one of three kinds: the pivot itself, a forward neighbour
(one of the pivot's best so far), or a reverse neighbour (a vector that has the pivot among its best, with its own
current k-th distance as bound). In a round all rows of a pivot meet in one task by a hash exchange on the pivot,
its neighbours in both directions are compared with each other where one of them is new, and only pairs that can
enter a list are sent on. Rounds go on until hardly any list changes. Rows are spread by pivot; a pivot with very
many reverse neighbours is worked on in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators.vectors import TASK_ROWS, from_binary, grouped, leaf_edges, leaves, to_binary, unpack, valid, whole
from mosaiq.session import Scratch

SELF, FORWARD, REVERSE = 0, 1, 2
GRAPH = "pivot long, nbr long, d2 double, bound double, kind byte, fresh boolean, v binary"
DELTA = 0.001  # share of list entries that still change, below which the descent ends
MANY_COPIES = 32  # a vector held by more rows than this is searched once, for all of them
PAIRS_AT_ONCE = 1_000_000


def _batch(pivot, nbr, d2, bound, kind, fresh, v) -> pa.RecordBatch:
    n = len(pivot)
    full = lambda x, t: np.full(n, x, t) if np.isscalar(x) else np.asarray(x, t)
    cols = [pa.array(full(pivot, np.int64)), pa.array(full(nbr, np.int64)), pa.array(full(d2, np.float64)), pa.array(full(bound, np.float64)), pa.array(full(kind, np.int8)), pa.array(full(fresh, bool)), v if isinstance(v, pa.Array) else to_binary(v)]
    return pa.RecordBatch.from_arrays(cols, ["pivot", "nbr", "d2", "bound", "kind", "fresh", "v"])


def _first_rows(dim: int, k: int, r2: float, most: int, seed: int):
    """Kernel: the leaves of a task to rows of the first graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        for ids, x in leaves(t, dim, most, seed):
            i, j, d2 = leaf_edges(x, ids, k, r2)
            if len(i):
                own = np.unique(i)
                yield _batch(ids[own], ids[own], 0.0, 0.0, SELF, False, x[own])
                yield _batch(ids[i], ids[j], d2, 0.0, FORWARD, True, x[j])

    return run


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of start .. start + count for each pair."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _descend(dim: int, k: int, r2: float):
    """Kernel of one round: merge the lists of each pivot, then compare neighbours of neighbours.

    A reverse neighbour is itself a candidate for the pivot's list. All forward and reverse neighbours of a pivot are
    compared with each other where one of the two is new to the pivot. A pair goes on only if it can enter a list:
    the bound of a reverse neighbour is its own k-th distance; a forward neighbour that doesn't have the pivot
    in its list has k others nearer than the pivot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        pivot, nbr, d2, bound, kind, fresh = (t.column(c).to_numpy() for c in ("pivot", "nbr", "d2", "bound", "kind", "fresh"))
        x = from_binary(t.column("v").chunk(0), dim)
        me = np.flatnonzero(kind == SELF)
        me = me[np.unique(pivot[me], return_index=True)[1]]
        own, mine = pivot[me], x[me]
        rows = np.flatnonzero(kind != SELF)
        # one entry for each neighbour of a pivot: reverse and forward at once, known before fresh
        order = rows[np.lexsort((fresh[rows], -kind[rows], nbr[rows], pivot[rows]))]
        pivot, nbr, d2, bound, kind, fresh, x = (c[order] for c in (pivot, nbr, d2, bound, kind, fresh, x))
        head = np.r_[True, (pivot[1:] != pivot[:-1]) | (nbr[1:] != nbr[:-1])] if len(pivot) else np.empty(0, bool)
        at = np.cumsum(head) - 1
        n = int(head.sum())
        known = np.zeros(n, bool)  # already in the pivot's list
        known[at[(kind == FORWARD) & ~fresh]] = True
        new = np.ones(n, bool)  # told to the pivot for the first time, in either direction
        new[at[~fresh]] = False
        told = np.zeros(n, bool)
        told[at[(kind == REVERSE) & fresh]] = True
        new |= told
        first = np.flatnonzero(head)
        pivot, nbr, d2, x, reverse = pivot[first], nbr[first], d2[first], x[first], kind[first] == REVERSE
        bound = np.where(reverse, bound[first], d2)
        # the k best of a pivot are its list
        order = np.lexsort((nbr, d2, pivot))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.searchsorted(pivot[order], pivot[order])
        listed = rank < k
        f = order[listed[order]]
        starts, ends = np.searchsorted(pivot[f], own), np.searchsorted(pivot[f], own, "right")
        kth = np.full(len(own), r2)
        full = ends - starts == k
        kth[full] = d2[f[ends[full] - 1]]
        mp = np.searchsorted(own, pivot[f])
        yield _batch(own, own, 0.0, 0.0, SELF, False, mine)
        yield _batch(pivot[f], nbr[f], d2[f], 0.0, FORWARD, False, x[f])
        yield _batch(nbr[f], pivot[f], d2[f], kth[mp], REVERSE, ~known[f], mine[mp])
        # neighbours of neighbours: all that are in the list or have the pivot in theirs
        b = np.flatnonzero(listed | reverse)
        group, b0, bn = np.unique(pivot[b], return_index=True, return_counts=True)
        per, start = np.repeat(bn, bn), np.repeat(b0, bn)
        block = np.searchsorted(np.cumsum(per), np.arange(0, per.sum() + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
        for lo, hi in zip(block[:-1], np.r_[block[1:-1], len(b)]):
            i, j = np.repeat(b[lo:hi], per[lo:hi]), b[_ranges(start[lo:hi], per[lo:hi])]
            keep = (new[i] | new[j]) & (i != j)
            i, j = i[keep], j[keep]
            e = x[i].astype(np.float64) - x[j]
            d = np.einsum("ij,ij->i", e, e)
            keep = d <= bound[i]
            if keep.any():
                i, j, d = i[keep], j[keep], d[keep]
                yield _batch(nbr[i], nbr[j], d, 0.0, FORWARD, True, x[j])

    return run


def _lists(dim: int, k: int):
    """Kernel: only the merged forward lists, as (src, dst, d2, rank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        src, dst, d2 = (t.column(c).to_numpy() for c in ("pivot", "nbr", "d2"))
        order = np.lexsort((dst, d2, src))
        src, dst, d2 = src[order], dst[order], d2[order]
        first = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]
        src, dst, d2 = src[first], dst[first], d2[first]
        rank = np.arange(len(src)) - np.searchsorted(src, src)
        keep = rank < k
        yield pa.RecordBatch.from_arrays([pa.array(src[keep]), pa.array(dst[keep]), pa.array(d2[keep]), pa.array((rank[keep] + 1).astype(np.int32))], ["src", "dst", "d2", "rank"])

    return run


def nn_descent(df: DataFrame, id_col: str, vec: str, dim: int, k: int = 5, radius: float = np.inf, trees: int = 3, leaf: int = 320, rounds: int = 12, seed: int = 7, scratch: Scratch | None = None, lists: int | None = None, graph: bool = False) -> DataFrame:
    """(src, dst, d2, rank): for each id its k nearest other ids, at most ``radius`` away, by Euclidean distance.

    The first lists come from a small forest of random splits (a usual start of NN-descent), in whose leaves all pairs
    are compared. Rounds of NN-descent follow, with ``lists`` neighbours a vector (three times k if not given), until
    less than DELTA of the list entries are new, or ``rounds`` are done. Approximate: a neighbour can be missed, a
    distance is never wrong. Ties go to the smaller id. Vectors that are null, of another length, or hold null, NaN or
    infinity don't count; repeated rows of an id count once. Vectors held by very many ids are searched once, and
    their holders get the smallest ids among themselves. An empty table gives no rows. With ``graph`` the last graph
    is returned, with vectors, for greedy search; of such copies it holds only the smallest id. With a ``radius`` lists
    hold nothing beyond it, so that the descent, too, goes through neighbours within it only.
    """
    s = scratch or Scratch(df.sparkSession, "knn")
    lists = lists or 3 * k
    df, *copies = _searched_once(s, df, id_col, vec, dim, k)
    rows = df.count()
    r2 = float(radius) ** 2
    g = grouped(df, "id", "v", dim, rows, trees, leaf, seed).mapInArrow(_first_rows(dim, lists, r2, 2 * leaf, seed), GRAPH)
    parts = max(8, -(-rows // TASK_ROWS) * (2 if np.isfinite(radius) else 6))
    for n in range(rounds + 1):  # the first pass only makes reverse rows, as there are none yet
        new = s.put(g.repartition(parts, "pivot").mapInArrow(_descend(dim, lists, r2), GRAPH), f"graph{n}")
        if n:
            s.drop(g)
        g = new
        if 0 < n < rounds:
            c = g.agg(F.count_if(F.expr(f"kind = {FORWARD} and not fresh")).alias("entries"), F.count_if(F.expr(f"kind = {REVERSE} and fresh")).alias("new")).first()
            if c["new"] <= DELTA * c["entries"]:
                break
    if graph:
        return g
    out = g.where(f"kind = {FORWARD}").select("pivot", "nbr", "d2").repartition(parts, "pivot").mapInArrow(_lists(dim, k), "src long, dst long, d2 double, rank int")
    return _with_copies(out, *copies, k) if copies else out


def _searched_once(s: Scratch, df: DataFrame, id_col: str, vec: str, dim: int, k: int) -> tuple[DataFrame, ...]:
    """(id, v) of valid vectors, of those held by very many ids only the smallest id; then, if there are any, all their
    holders (h, id) and the k + 1 smallest of each (h, id, n)."""
    df = valid(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("v")).where("id is not null"), "v", dim)
    held = df.groupBy("id").agg(F.min(F.xxhash64("v")).alias("h"))
    # so many that each has k others
    many = s.put(held.groupBy("h").count().where(F.col("count") > max(MANY_COPIES, k)).select("h"), "copies")
    if many.isEmpty():
        return (df,)
    members = s.put(held.join(many, "h").select("h", "id"), "members")
    w = W.partitionBy("h").orderBy("id")
    least = s.put(members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1), "least")
    others = members.join(least.where("n = 1").select("id"), "id", "left_anti")
    return df.join(others.select("id"), "id", "left_anti"), members, least


def _with_copies(edges: DataFrame, members: DataFrame, least: DataFrame, k: int, of: DataFrame | None = None) -> DataFrame:
    """Lists in which a searched copy stands for all its holders; those of holders only if they are in ``of``, if given."""
    top = least.select("h", F.col("id").alias("dst"))
    among = (members if of is None else members.join(of, "id", "left_semi")).select("h", F.col("id").alias("src")).join(top, "h").where("src <> dst").select("src", "dst", F.lit(0.0).alias("d2"))
    heads = least.where("n = 1").select(F.col("id").alias("head"), "h")
    out = edges.select("src", "dst", "d2").join(members.select(F.col("id").alias("src")), "src", "left_anti")
    out = out.join(heads, out["dst"] == heads["head"], "left").join(top.withColumnRenamed("dst", "copy"), "h", "left")
    out = out.select("src", F.coalesce("copy", "dst").alias("dst"), "d2").unionByName(among)
    w = W.partitionBy("src").orderBy("d2", "dst")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def near_pairs(df: DataFrame, id_col: str, vec: str, dim: int, radius: float, k: int = 5, **kw) -> DataFrame:
    """(id_1, id_2): pairs at most ``radius`` apart of which one is among the other's k nearest, smaller id first."""
    e = nn_descent(df, id_col, vec, dim, k=k, radius=radius, **kw)
    return e.select(F.least("src", "dst").alias("id_1"), F.greatest("src", "dst").alias("id_2")).distinct()


def _distance(dim: int):
    """Kernel: squared distances of query vectors and candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = from_binary(b.column("qv"), dim).astype(np.float64) - from_binary(b.column("v"), dim)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("node"), pa.array(np.einsum("ij,ij->i", e, e))], ["q", "node", "d2"])

    return run


def entries(nodes: DataFrame, queries: DataFrame, dim: int, n: int, trees: int = 2, leaf: int = 320, seed: int = 23) -> DataFrame:
    """(q, node, d2): where a greedy search for vectors outside the graph begins: the n nearest nodes in their leaves.

    ``nodes`` and ``queries`` hold id and v. A query whose leaves hold no node has no entry.
    """
    both = nodes.select((F.col("id") * 2).alias("id"), "v").unionAll(queries.select((F.col("id") * 2 + 1).alias("id"), "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        for ids, x in leaves(t, dim, 2 * leaf, seed):
            q, r = np.flatnonzero(ids % 2 == 1), np.flatnonzero(ids % 2 == 0)
            if not len(q) or not len(r):
                continue
            e = x[q].astype(np.float64)[:, None] - x[r].astype(np.float64)[None]
            d = np.einsum("ijk,ijk->ij", e, e)
            j = np.argsort(d, axis=1, kind="stable")[:, :n]
            i = np.repeat(np.arange(len(q)), j.shape[1])
            j = j.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(ids[q[i]] // 2), pa.array(ids[r[j]] // 2), pa.array(d[i, j])], ["q", "node", "d2"])

    g = grouped(both, "id", "v", dim, both.count(), trees, leaf, seed).mapInArrow(run, "q long, node long, d2 double").distinct()
    w = W.partitionBy("q").orderBy("d2", "node")
    return g.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).drop("n")


def greedy_search(graph: DataFrame, queries: DataFrame, dim: int, k: int, beam: int = 24, expand: int = 3, most_rounds: int = 30, scratch: Scratch | None = None, start: DataFrame | None = None) -> DataFrame:
    """(src, dst, d2, rank): the k nearest of each query by greedy search in a graph of nn_descent(graph=True).

    ``queries`` (id) are vectors of the graph, each of which starts from its own list and isn't found itself; or, with
    ``start`` (see entries), they are any vectors (id, v as binary) that begin there. Each round the ``expand`` nearest
    nodes that weren't visited yet are opened and their neighbours join the beam of the nearest found, until no beam
    holds an unopened node among its first 2 k. Queries without a place to begin get no rows.
    """
    s = scratch or Scratch(graph.sparkSession, "search")
    edge = s.put(graph.where(f"kind = {FORWARD}").select(F.col("pivot").alias("at"), F.col("nbr").alias("node"), "v", "d2").dropDuplicates(["at", "node"]), "edges")
    if start is None:
        q = s.put(graph.where(f"kind = {SELF}").select(F.col("pivot").alias("q"), F.col("v").alias("qv")).join(queries.select(F.col("id").alias("q")).distinct(), "q").dropDuplicates(["q"]), "queries")
        b = edge.join(q.select(F.col("q").alias("at")), "at").select(F.col("at").alias("q"), "node", "d2")
    else:
        q = s.put(queries.select(F.col("id").alias("q"), F.col("v").alias("qv")).dropDuplicates(["q"]), "queries")
        b = start.select("q", "node", "d2")
    inside = start is None
    by_rank = W.partitionBy("q").orderBy("d2", "node")
    b = s.put(b.withColumn("open", F.lit(False)), "beam")
    for _ in range(most_rounds):
        n = F.row_number().over(W.partitionBy("q").orderBy("open", "d2", "node"))
        r = b.withColumn("rank", F.row_number().over(by_rank)).withColumn("turn", n)
        go = s.put(r.where(~F.col("open") & (F.col("turn") <= expand) & (F.col("rank") <= 2 * k)).select("q", F.col("node").alias("at")), "turn")
        if go.isEmpty():
            break
        got = go.join(edge.select("at", "node", "v"), "at").where("node <> q" if inside else "true").select("q", "node", "v").dropDuplicates(["q", "node"])
        got = got.join(b.select("q", "node"), ["q", "node"], "left_anti").join(q, "q").select("q", "qv", "node", "v").mapInArrow(_distance(dim), "q long, node long, d2 double")
        seen = b.join(go.withColumnRenamed("at", "node").withColumn("went", F.lit(True)), ["q", "node"], "left").select("q", "node", "d2", (F.col("open") | F.coalesce("went", F.lit(False))).alias("open"))
        nxt = seen.unionByName(got.withColumn("open", F.lit(False))).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= beam).drop("rank")
        new = s.put(nxt, "beam")
        s.drop(b, go)
        b = new
    return b.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select(F.col("q").alias("src"), F.col("node").alias("dst"), "d2", "rank")


def search(df: DataFrame, queries: DataFrame, id_col: str, vec: str, dim: int, k: int = 5, graph_k: int = 12, rounds: int = 12, trees: int = 3, leaf: int = 320, scratch: Scratch | None = None) -> DataFrame:
    """(src, dst, d2, rank): the k nearest of the queries among all rows, through an NN-descent graph.

    ``queries`` holds ids of rows (column id), or any vectors (columns id and v), which find rows of the same id, too.
    Of a vector held by very many ids one is searched and found for all; its holders get the smallest ids among them.
    Outside vectors that are null, of another length, or not finite get no rows.
    """
    s = scratch or Scratch(df.sparkSession, "search")
    once, *copies = _searched_once(s, df, id_col, vec, dim, k)
    of = queries.select(F.col("id").cast("long").alias("id"), *(["v"] if "v" in queries.columns else []))
    once = s.put(once, "once")
    g = nn_descent(once, "id", "v", dim, lists=graph_k, trees=trees, leaf=leaf, rounds=rounds, scratch=s, graph=True)
    if "v" in of.columns:
        of = s.put(valid(of, "v", dim), "outside").select("id", F.col("v").cast("array<float>").alias("v"))
        found = greedy_search(g, of.mapInArrow(_as_binary(dim), "id long, v binary"), dim, k, scratch=s, start=entries(once, of, dim, graph_k))
        return _expanded(found, *copies, k) if copies else found
    if not copies:
        return greedy_search(g, of, dim, k, scratch=s)
    members, least = copies
    found = greedy_search(g, of.join(members.select("id"), "id", "left_anti"), dim, k, scratch=s)
    return _with_copies(found, members, least, k, of)


def _as_binary(dim: int):
    """Kernel: vectors as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = unpack(b.column("v"), dim)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), to_binary(x)], ["id", "v"])

    return run


def _expanded(edges: DataFrame, members: DataFrame, least: DataFrame, k: int) -> DataFrame:
    """Lists in which a searched copy found stands for all its holders."""
    top = least.select("h", F.col("id").alias("copy"))
    heads = least.where("n = 1").select(F.col("id").alias("dst"), "h")
    out = edges.select("src", "dst", "d2").join(heads, "dst", "left").join(top, "h", "left").select("src", F.coalesce("copy", "dst").alias("dst"), "d2")
    w = W.partitionBy("src").orderBy("d2", "dst")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
