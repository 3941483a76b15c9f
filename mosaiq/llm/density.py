"""Hierarchical density clustering of vectors.

Mutual-reachability neighbour graph -> minimum spanning forest (Borůvka) -> condensed hierarchy -> clusters by
stability -> exemplars. The graph comes from a forest of random splits, within whose leaves all pairs count. Borůvka
runs in two parts: first inside regions of space, each a task that knows all edges at its vertices and contracts what
is certain, then in Spark over the components that are left. The hierarchy is exact for the spanning forest:
vertices come into components of the least size that counts, in parts of bounded size, then the tree of these is worked on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators import communities, vectors
from mosaiq.operators.forests import local_forest
from mosaiq.operators.vectors import leaf_edges, leaves, route, whole
from mosaiq.session import Scratch

MIN_CLUSTER = 50
MOST_ANCHORS = 100_000  # more anchors than these aren't sent to all tasks
REGION_ROWS = 60_000  # vertices that are contracted in one task, on average
EDGE = "region long, a long, b long, w double, ra long, rb long"


def leaf_forest(x: np.ndarray, r2: float, core: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2): minimum spanning forest of all pairs of rows at a squared distance of at most r2 (Prim).

    With ``core`` distances the weight of a pair is its mutual reachability.
    """
    n = len(x)
    if n < 2:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    x = x.astype(np.float64)
    c = x - x.mean(0)
    sq = (c * c).sum(1)
    d = sq[:, None] + sq[None] - 2 * (c @ c.T)
    c2 = np.zeros(n) if core is None else core.astype(np.float64) ** 2
    np.maximum(d, np.maximum(c2[:, None], c2[None]), out=d)
    near, by = np.full(n, np.inf), np.zeros(n, int)  # of each vertex outside: distance to the tree, and from where
    to, at = np.full(n, -1), 0
    out = np.ones(n, bool)
    limit = r2 + 1e-9 * (float(sq.max()) + 1e-6)  # checked exactly below
    for _ in range(n - 1):
        out[at] = False
        near[at] = np.inf
        row = d[at]
        less = (row < near) & out
        near[less], by[less] = row[less], at
        nxt = int(near.argmin())
        if near[nxt] <= limit:
            to[nxt] = by[nxt]
        else:  # nothing more within reach: another tree starts
            nxt = int(out.argmax())
        at = nxt
    i = np.flatnonzero(to >= 0)
    j = to[i]
    e = x[i] - x[j]
    d2 = np.maximum(np.einsum("ij,ij->i", e, e), np.maximum(c2[i], c2[j]))
    keep = d2 <= r2
    return i[keep], j[keep], d2[keep]


def _nearest(dim: int, k: int, r2: float, most: int, seed: int):
    """Kernel: leaves of a task to the k nearest of each vector, as (s, o, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        for ids, x in leaves(t, dim, most, seed):
            i, j, d2 = leaf_edges(x, ids, k, r2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(np.sqrt(d2))], ["s", "o", "w"])

    return run


def _edge_rows(dim: int, cored: bool, r2: float, most: int, seed: int, region_of):
    """Kernel: leaves of a task to the minimum spanning forests of all their pairs, each edge sent to the region of either end.

    With ``cored`` the last number of a vector is its core distance.
    """
    wide = dim + cored

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        parts, start = [], 0
        for ids, x in leaves(t, wide, most, seed):
            y = np.ascontiguousarray(x[:, :dim])
            i, j, d2 = leaf_forest(y, r2, x[:, dim] if cored else None)
            parts.append((i + start, j + start, d2, ids, region_of(y)))
            start += len(ids)
        i, j, d2 = (np.concatenate([p[n] for p in parts]) for n in range(3))
        ids, reg = (np.concatenate([p[n] for p in parts]) for n in (3, 4))
        a, b = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        order = np.lexsort((ids[b], ids[a], d2))
        a, b, w = a[order], b[order], np.sqrt(d2[order])
        keep = local_forest(a, b, np.ones(start, bool), start)[1]  # what the leaves' own forests leave out can't be in that of all
        a, b, w = a[keep], b[keep], w[keep]
        ra, rb = reg[a], reg[b]
        for r, m in ((ra, np.ones(len(a), bool)), (rb, ra != rb)):
            yield pa.RecordBatch.from_arrays([pa.array(r[m]), pa.array(ids[a][m]), pa.array(ids[b][m]), pa.array(w[m]), pa.array(ra[m]), pa.array(rb[m])], ["region", "a", "b", "w", "ra", "rb"])

    return run


CONTRACTED = "kind byte, a long, b long, w double, la long, lb long"
TREE, LABEL, REST = 0, 1, 2


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: the edges at the vertices of whole regions to forest edges, vertex labels and what is left."""
    t = whole(batches)
    if t is None:
        return
    region, a, b, w, ra, rb = (t.column(c).to_numpy() for c in ("region", "a", "b", "w", "ra", "rb"))
    here = np.unique(region)
    order = np.lexsort((b, a, w))
    a, b, w, ra, rb = a[order], b[order], w[order], ra[order], rb[order]
    _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)  # the same edge from other trees, or by both ends
    first.sort()
    a, b, w, ra, rb = a[first], b[first], w[first], ra[first], rb[first]
    ids, inv = np.unique(np.r_[a, b], return_inverse=True)
    u, v = inv[: len(a)], inv[len(a) :]
    own = np.zeros(len(ids), bool)
    own[u], own[v] = np.isin(ra, here), np.isin(rb, here)
    label, chosen = local_forest(u, v, own, len(ids))
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids)  # a component's name is its smallest id; foreign vertices stay alone
    name = low[label]
    names = ["kind", "a", "b", "w", "la", "lb"]
    out = lambda kind, a, b, w, la, lb: pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(w), pa.array(la), pa.array(lb)], names)
    c = chosen
    yield out(TREE, a[c], b[c], w[c], name[u[c]], name[v[c]])
    o = np.flatnonzero(own)
    yield out(LABEL, ids[o], ids[o], np.zeros(len(o)), name[o], name[o])
    in_msf = np.zeros(len(a), bool)  # an edge that is the heaviest of a cycle here can't be in the whole forest
    in_msf[local_forest(u, v, np.ones(len(ids), bool), len(ids))[1]] = True
    rest = np.flatnonzero((label[u] != label[v]) & in_msf)
    label_of = lambda end: pa.array(name[end], mask=~own[end])  # noqa: E731  the label of a foreign end is known elsewhere
    yield out(REST, a[rest], b[rest], w[rest], label_of(u[rest]), label_of(v[rest]))


def boruvka(s: Scratch, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest of edges (u, v, w, a, b) between components u and v, a < b being their ends.

    Returns (label, root) for each component that has edges, and the forest's edges (a, b, w). Weights are ordered
    by (w, a, b), so that equal weights make no cycle. Each round, a component joins along its lightest edge, which
    at least halves the number of components; pointers are resolved by doubling.
    """
    e = s.put(edges.where("u <> v").select("u", "v", "w", "a", "b"), "edges")
    roots, trees = None, []
    while n_edges := e.count():
        if n_edges <= communities.IN_ONE_TASK:
            last = s.put(e.coalesce(1).mapInArrow(_finish, FINISHED), "last")
            trees.append(last.where("kind = 0").select("a", "b", "w"))
            p = last.where("kind = 1").select(F.col("a").alias("c"), F.col("b").alias("r"))
        else:
            pick = lambda c, o: e.select(F.col(c).alias("c"), F.struct("w", "a", "b", F.col(o).alias("o")).alias("e"))
            best = s.put(pick("u", "v").unionAll(pick("v", "u")).groupBy("c").agg(F.min("e").alias("e")), "best")
            trees.append(s.put(best.select("e.a", "e.b", "e.w").distinct(), "tree"))
            p = best.select("c", F.col("e.o").alias("p"))
            back = p.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            p = p.join(back, "p", "left").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
            p = s.put(p, "parents")
            s.drop(best)
            while True:
                up = p.select(F.col("c").alias("p"), F.col("p").alias("pp"))
                nxt = s.put(p.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")), "parents")
                s.drop(p)
                p = nxt
                if p.where("moved").isEmpty():
                    break
            p = p.select("c", F.col("p").alias("r"))
        if roots is None:
            roots = s.put(p.select(F.col("c").alias("label"), F.col("r").alias("root")), "roots")
        else:
            new_roots = s.put(roots.join(p.withColumnRenamed("c", "root"), "root", "left").select("label", F.coalesce("r", "root").alias("root")), "roots")
            s.drop(roots)
            roots = new_roots
        if n_edges <= communities.IN_ONE_TASK:
            break
        n = e.join(p.toDF("u", "ru"), "u").join(p.toDF("v", "rv"), "v").where("ru <> rv")
        n = n.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min(F.struct("w", "a", "b")).alias("e")).select("u", "v", "e.w", "e.a", "e.b")
        nxt = s.put(n, "edges")
        s.drop(e)
        e = nxt
    spark = edges.sparkSession
    if roots is None:
        return spark.createDataFrame([], "label long, root long"), spark.createDataFrame([], "a long, b long, w double")
    tree = trees[0]
    for t in trees[1:]:
        tree = tree.unionByName(t)
    return roots, tree


FINISHED = "kind byte, a long, b long, w double"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: all edges of a task to forest edges (kind 0: a, b, w) and the component of each end (kind 1: a, b)."""
    t = whole(batches)
    if t is None:
        return
    u, v, w, a, b = (t.column(c).to_numpy() for c in ("u", "v", "w", "a", "b"))
    order = np.lexsort((b, a, w))
    ids, inv = np.unique(np.r_[u, v], return_inverse=True)
    label, chosen = local_forest(inv[: len(u)][order], inv[len(u) :][order], np.ones(len(ids), bool), len(ids))
    c = order[chosen]
    rows = lambda kind, a, b, w: pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int8)), pa.array(a), pa.array(b), pa.array(w)], ["kind", "a", "b", "w"])
    yield rows(0, a[c], b[c], w[c])
    yield rows(1, ids, ids[label], np.zeros(len(ids)))


def spanning_forest(df: DataFrame, id_col: str, vec: str, dim: int, radius: float, min_samples: int = 2, trees: int = 3, leaf: int = 320, seed: int = 11, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest of the mutual-reachability graph, and the component of each vertex.

    The mutual reachability of two vectors is the largest of their distance and their core distances; a core
    distance is that to the (min_samples - 1)-th nearest other vector. Edges longer than ``radius`` are left out.
    For min_samples up to 2 the mutual reachability is the distance itself, as no other vector is nearer than the
    nearest. Leaves send on only their own forests, of all their pairs. Equal vectors take part as one, their
    smallest id, and its copies join its component afterwards. Returns edges (a, b, w) and (id, component) of all
    vectors that have an edge. Vectors that are null, short or not finite don't count, repeated rows of an id count
    once. An edge whose ends all trees separate is missed.
    """
    s = scratch or Scratch(df.sparkSession, "density")
    df, held, members = _heads(s, df, id_col, vec, dim)
    rows = df.count()
    depth = max(0, int(np.ceil(np.log2(max(rows, 1) / REGION_ROWS))))
    sample = vectors.sample_vectors(df, "v", dim, rows, seed + 1)
    depth = min(depth, int(np.log2(max(len(sample) / 8, 1))))
    tree = vectors.fit_forest(sample, 1, depth, seed + 1)[0]
    cored, r2 = min_samples > 2, float(radius) ** 2
    if cored:
        near = vectors.grouped(df, "id", "v", dim, rows, trees, leaf, seed).mapInArrow(_nearest(dim, min_samples - 1, r2, 2 * leaf, seed), "s long, o long, w double")
        core = s.put(_cores(near, held, min_samples), "cores")
        df = df.join(core, "id").select("id", F.concat("v", F.array(F.col("core").cast("float"))).alias("v"))
    g = vectors.grouped(df, "id", "v", dim + cored, rows, trees, leaf, seed)
    e = g.mapInArrow(_edge_rows(dim, cored, r2, 2 * leaf, seed, lambda x: route(x, tree)), EDGE)
    regions = max(1, -(-rows // REGION_ROWS))
    c = s.put(e.repartition(regions, "region").mapInArrow(_contract, CONTRACTED), "contracted")
    labels = c.where(f"kind = {LABEL}").select(F.col("a").alias("id"), F.col("la").alias("label"))
    rest = c.where(f"kind = {REST}").groupBy("a", "b").agg(F.min("w").alias("w"), F.max("la").alias("u"), F.max("lb").alias("v"))
    rest = rest.where("u is not null and v is not null")  # kept in the regions of both ends
    roots, forest = boruvka(s, rest)
    comp = s.put(labels.join(roots, "label", "left").select("id", F.coalesce("root", "label").alias("component")), "components")
    forest = c.where(f"kind = {TREE}").select("a", "b", "w").unionByName(forest)
    # copies hang on their head, by its core distance
    own = held.select("head").join(core.toDF("head", "w"), "head") if cored else held.select(F.col("head"), F.lit(0.0).alias("w"))
    link = s.put(members.join(own, "head").select(F.col("head").alias("a"), F.col("id").alias("b"), "w"), "links")
    at = own.select("head").join(comp.withColumnRenamed("id", "head"), "head", "left").select("head", F.coalesce("component", "head").alias("component"))
    ends = link.select(F.col("a").alias("head"), F.col("b").alias("id")).unionAll(own.join(comp.select(F.col("id").alias("head")), "head", "left_anti").select("head", F.col("head").alias("id")))
    return forest.unionByName(link), comp.unionByName(ends.join(at, "head").select("id", "component"))


def _heads(s: Scratch, df: DataFrame, id_col: str, vec: str, dim: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, v) with one id per valid vector, (head, n) of vectors held by n > 1 ids, (id, head) of the other holders)."""
    d = vectors.valid(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("v")).where("id is not null"), "v", dim)
    h = d.groupBy("id").agg(F.min(F.xxhash64("v")).alias("h"))
    held = s.put(h.groupBy("h").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1"), "held")
    members = s.put(h.join(held, "h").where("id <> head").select("id", "head"), "members")
    return s.put(d.join(members.select("id"), "id", "left_anti"), "heads"), held.select("head", "n"), members


def _cores(near: DataFrame, held: DataFrame, min_samples: int) -> DataFrame:
    """(id, core) from lists of nearest vectors (s, o, w), of the vectors that have so many others within the radius.

    A vector held by n ids counts n times among the nearest of others and n - 1 times among its own.
    """
    both = near.unionAll(near.select(F.col("o").alias("s"), F.col("s").alias("o"), "w")).distinct()
    both = both.join(held.toDF("o", "n"), "o", "left").select("s", "o", "w", F.coalesce("n", F.lit(1)).alias("n"))
    both = both.unionByName(held.select(F.col("head").alias("s"), F.col("head").alias("o"), F.lit(0.0).alias("w"), (F.col("n") - 1).alias("n")))
    w = W.partitionBy("s").orderBy("w", "o").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("n", F.sum("n").over(w)).where(F.col("n") >= min_samples - 1).groupBy(F.col("s").alias("id")).agg(F.min("w").alias("core"))


MOST_EDGES = 200_000  # forest edges of one component that a task works on in order
FATE = "a long, b long, n long, w double"


def _come_in(min_size: int):
    """Kernel: edges of whole groups of small components, in order of weight, to what becomes of these: (a, b, n, w).

    n is a component's size, 0 for a base, which is what has reached min_size: a small component a is in b now, which is a
    base since the weight w, or a small one of size n. Groups don't go through bases, so a base can stand in many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        r, u, v, w, nu, nv = (t.column(c).to_numpy() for c in ("r", "u", "v", "w", "nu", "nv"))
        n = np.r_[nu, nv]
        key, at, inv = np.unique(np.stack([np.r_[u, v], np.where(n > 0, 0, np.r_[r, r]), n == 0]), axis=1, return_index=True, return_inverse=True)
        inv, size = inv.ravel(), n[at].tolist()
        order = np.argsort(w, kind="stable")
        u, v, w = inv[: len(w)][order].tolist(), inv[len(w) :][order].tolist(), w[order].tolist()
        name, count = key[0].tolist(), len(at)
        base = [x if k == 0 else None for x, k in zip(name, size)]
        parent, members, fate = list(range(count)), {}, []

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        i, m = 0, len(w)
        while i < m:
            at, parts = w[i], {}
            while i < m and w[i] == at:  # edges of equal weight are one event
                p, q = find(u[i]), find(v[i])
                i += 1
                if p != q:
                    if len(members.get(p, ())) < len(members.get(q, ())):
                        p, q = q, p
                    parts[p] = (parts.pop(p, None) or [p]) + (parts.pop(q, None) or [q])
                    parent[q] = p
            for p, old in parts.items():
                small = [x for x in old if base[x] is None]
                kept = [base[x] for x in old if base[x] is not None]
                total, low = sum(size[x] for x in small), min((name[x] for x in small), default=None)
                into = kept[0] if kept else low if total >= min_size else None
                inside = [z for x in small for z in members.pop(x, (x,))]
                if into is None:
                    members[p], size[p], name[p] = inside, total, low
                else:
                    fate += [(z, into, 0, at) for z in inside]
                    base[p] = into
        for p, inside in members.items():
            fate += [(z, name[p], size[p], None) for z in inside]
        if fate:
            z, b, k, at = zip(*fate)
            yield pa.RecordBatch.from_arrays([pa.array(key[0][list(z)]), pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(at, pa.float64())], ["a", "b", "n", "w"])

    return run


def _come_in_at_once(tagged: DataFrame, min_size: int) -> DataFrame:
    """What _come_in gives if all edges of a group have one weight, by aggregation."""
    ends = tagged.select("r", "w", F.col("u").alias("a"), F.col("nu").alias("n")).unionAll(tagged.select("r", "w", "v", "nv")).distinct()
    g = ends.groupBy("r").agg(F.min(F.when(F.col("n") == 0, F.col("a"))).alias("base"), F.sum("n").alias("total"), F.min(F.when(F.col("n") > 0, F.col("a"))).alias("low"))
    into = F.coalesce("base", F.when(F.col("total") >= min_size, F.col("low")))
    g = g.select("r", F.coalesce(into, "low").alias("b"), F.when(into.isNull(), F.col("total")).otherwise(0).alias("k"))
    return ends.where("n > 0").join(g, "r").select("a", "b", F.col("k").alias("n"), F.when(F.col("k") == 0, F.col("w")).alias("w"))


def bases(s: Scratch, forest: DataFrame, min_size: int, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Where the vertices of a spanning forest first are in a component of min_size, and the edges that join such components.

    Returns (id, base, w), w being the weight at which the vertex came into the base, (id, component) of vertices that come
    into none, and edges (u, v, w) between bases. As a base only takes in what hangs on it, the forest falls apart at it:
    each part goes on by itself, so the rounds don't grow with the components. A part of more than most_edges edges is worked
    on up to a smaller weight, the others meanwhile further.
    """
    one = F.lit(1).cast("long")
    e = s.put(forest.select(F.col("a").alias("u"), F.col("b").alias("v"), "w", one.alias("nu"), one.alias("nv")).where("u <> v"), "order")
    v = s.put(forest.select(F.col("a").alias("id")).unionAll(forest.select("b")).distinct().withColumn("c", F.col("id")), "vertices")
    placed, core = [], []
    while left := e.count():
        parts = max(8, -(-left // most_edges))
        now, fates = e, []
        if left > most_edges:
            now = e.where(F.col("w") <= e.agg(F.percentile_approx("w", 0.5, 10_000)).first()[0])
        while True:
            root = communities.connected(s, now.where("nu > 0 and nv > 0").select("u", "v")).toDF("c", "r")
            own = now.withColumn("c", F.when(F.col("nu") > 0, F.col("u")).otherwise(F.col("v")))
            tagged = s.put(own.join(root, "c", "left").select(F.coalesce("r", "c").alias("r"), "u", "v", "w", "nu", "nv"), "now")
            big = s.put(tagged.groupBy("r").agg(F.count("*").alias("n"), F.min("w").alias("least"), F.max("w").alias("most")).where(F.col("n") > most_edges), "big")
            small = tagged.join(big.select("r"), "r", "left_anti")
            fates.append(s.put(small.repartition(parts, "r").mapInArrow(_come_in(min_size), FATE), "fate"))
            if big.isEmpty():
                break
            equal = big.where("least = most").select("r")
            if not equal.isEmpty():
                fates.append(s.put(_come_in_at_once(tagged.join(equal, "r", "left_semi"), min_size), "fate"))
            # each of the others up to the middle of its own weights, or to its least if that leaves them as they are
            more = tagged.join(big.where("least < most").select("r", "least", "most"), "r")
            half = more.groupBy("r").agg(F.percentile_approx("w", 0.5, 10_000).alias("half"))
            more = more.join(half, "r").where(F.col("w") <= F.when(F.col("half") < F.col("most"), F.col("half")).otherwise(F.col("least")))
            now = s.put(more.select("u", "v", "w", "nu", "nv"), "now")
            s.drop(tagged)
            if now.isEmpty():
                break
        fate = fates[0]
        for f in fates[1:]:
            fate = fate.unionByName(f)
        to = fate.select(F.col("a").alias("c"), "b", "n", F.col("w").alias("at"))
        moved = s.put(v.join(to, "c", "left").select("id", F.coalesce("b", "c").alias("c"), "n", "at"), "vertices")
        placed.append(moved.where("n = 0").select("id", F.col("c").alias("base"), F.col("at").alias("w")))
        v = moved.where("n is null or n > 0").select("id", "c")
        end = lambda x: to.select(F.col("c").alias(x), F.col("b").alias(f"b{x}"), F.col("n").alias(f"m{x}"))
        named = lambda x: [F.coalesce(f"b{x}", x).alias(x), F.coalesce(f"m{x}", f"n{x}").alias(f"n{x}")]
        nxt = s.put(e.join(end("u"), "u", "left").join(end("v"), "v", "left").select(*named("u"), *named("v"), "w").where("u <> v"), "order")
        core.append(nxt.where("nu = 0 and nv = 0").select("u", "v", "w"))
        e = nxt.where("nu > 0 or nv > 0").select("u", "v", "w", "nu", "nv")
    spark = forest.sparkSession
    at, joins = spark.createDataFrame([], "id long, base long, w double"), spark.createDataFrame([], "u long, v long, w double")
    for x in placed:
        at = at.unionByName(x)
    for x in core:
        joins = joins.unionByName(x)
    return s.put(at, "placed"), v.select("id", F.col("c").alias("component")), s.put(joins, "core")


STEP_OUT = "kind byte, a long, b long, x double, size long, below double, self boolean, w double"
COMPONENT, EDGE_ROW, GAIN = 0, 1, 2
ALIVE, CLOSED = 0, 2


def _join_up(eps: float):
    """Kernel: components and the edges that join them to what they become, in order of weight.

    Rows of a task are whole groups of components that its edges connect, and what their nodes gain later (GAIN: size and
    s1 of a node). Out come the components that are left (ALIVE: name, node, s1, size, below) and the nodes that ended in
    another (CLOSED: node, parent, own stability, size, whether it is at least as stable as the best below it, weight). A
    node is named after the base that it begins as, or the component that ends with it: 2 c, or 2 c + 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        kind, a, b, w = (t.column(c).to_numpy() for c in ("kind", "a", "b", "w"))
        e, c, g = (np.flatnonzero(kind == k) for k in (EDGE_ROW, COMPONENT, GAIN))
        col = lambda name, rows: t.column(name).to_numpy()[rows].tolist()
        gains = dict(zip(col("node", g), zip(col("size", g), col("s1", g))))
        ids, inv = np.unique(a[c], return_inverse=True)
        n = len(ids)
        size, node, s1, below = [0] * n, [0] * n, [0.0] * n, [0.0] * n
        for i, *x in zip(inv.tolist(), col("size", c), col("node", c), col("s1", c), col("below", c)):
            size[i], node[i], s1[i], below[i] = int(x[0]), int(x[1]), x[2], x[3]
        e = e[np.argsort(w[e], kind="stable")]
        u, v, w = np.searchsorted(ids, a[e]).tolist(), np.searchsorted(ids, b[e].astype(np.int64)).tolist(), w[e].tolist()
        name, parent = ids.tolist(), list(range(n))

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        closed = []
        i, m = 0, len(w)
        while i < m:
            at, parts = w[i], {}
            while i < m and w[i] == at:  # edges of equal weight are one event
                p, q = find(u[i]), find(v[i])
                i += 1
                if p != q:
                    if size[p] < size[q]:
                        p, q = q, p
                    got = parts.pop(p, None) or [(p, size[p])]
                    got += parts.pop(q, None) or [(q, size[q])]
                    parts[p] = got
                    parent[q] = p
                    size[p] += size[q]
            density = 1.0 / (at + eps)
            for p, old in parts.items():
                now, low = 2 * max(name[x] for x, _ in old) + 1, 0.0
                more, s = gains.get(now, (0, 0.0))
                for x, n_x in old:
                    own = s1[x] - n_x * density
                    closed.append((node[x], now, own, n_x, own >= below[x], at))
                    low += max(own, below[x])
                node[p], s1[p], below[p], name[p] = now, size[p] * density + s, low, min(name[x] for x, _ in old)
                size[p] += int(more)
        cols = ["kind", "a", "b", "x", "size", "below", "self", "w"]

        def rows(kind: int, a, b, x, size, below=None, self=None, w=None) -> pa.RecordBatch:
            k = len(a)
            null = lambda v, ty: pa.nulls(k, ty) if v is None else pa.array(v, ty)
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(x, pa.float64()), pa.array(size, pa.int64()), null(below, pa.float64()), null(self, pa.bool_()), null(w, pa.float64())], cols)

        left = [p for p in range(n) if parent[p] == p]
        pick = lambda col: [col[p] for p in left]
        yield rows(ALIVE, pick(name), pick(node), pick(s1), pick(size), pick(below))
        if closed:
            node_, to, own, n_, self_, at_ = zip(*closed)
            yield rows(CLOSED, node_, to, own, n_, None, self_, at_)

    return run


def _one_event(root: DataFrame, comp: DataFrame, gains: DataFrame, weight: float, eps: float) -> DataFrame:
    """What _join_up gives if all edges have one weight, as joins and aggregations: no group meets in a task."""
    density = 1.0 / (weight + eps)
    c = comp.join(root, "c").select("c", "r", "size", "node", "s1", "below")
    own = F.col("s1") - F.col("size") * density
    g = c.groupBy("r").agg(F.sum("size").alias("total"), (F.max("c") * 2 + 1).alias("now"), F.sum(F.greatest(own, "below")).alias("best"))
    g = g.join(gains.toDF("now", "n", "d"), "now", "left")
    row = lambda df, kind, a, b, x, size, low, self, w: df.select(F.lit(kind).cast("byte").alias("kind"), a.alias("a"), b.alias("b"), x.cast("double").alias("x"), size.cast("long").alias("size"), low.cast("double").alias("below"), self.cast("boolean").alias("self"), w.cast("double").alias("w"))
    none = F.lit(None)
    alive = row(g, ALIVE, F.col("r"), F.col("now"), F.col("total") * density + F.coalesce("d", F.lit(0.0)), F.col("total") + F.coalesce("n", F.lit(0)), F.col("best"), none, none)
    return alive.unionByName(row(c.join(g, "r"), CLOSED, F.col("node"), F.col("now"), own, F.col("size"), none, own >= F.col("below"), F.lit(weight)))


def _merged(s: Scratch, core: DataFrame, comp: DataFrame, gains: DataFrame, eps: float, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """What bases (c, size, node, s1, below) and the edges (u, v, w) between them come to: (the same of what is left, closed nodes).

    gains (node, n, d) are the vertices that come in after a node has begun, and the sum of their densities. Edges are
    worked on up to a weight, in components of at most most_edges edges, each in one task; then these are contracted.
    Equal weights that join more are one event, made by aggregation.
    """
    where = comp.select(F.col("c").alias("base"), "c")
    closed = comp.sparkSession.createDataFrame([], "node long, parent long, own double, size long, self boolean, w double")
    e, left = core, core.count()
    while left:
        t, event = None, False
        if left > most_edges:
            t = e.agg(F.percentile_approx("w", 0.5, 10_000)).first()[0]
        while True:
            now = e if t is None else e.where(F.col("w") <= t)
            root = s.put(communities.connected(s, now).toDF("c", "r"), "root")
            tagged = s.put(now.join(root.toDF("u", "r"), "u").select("r", "u", "v", "w"), "now")
            if t is None or tagged.groupBy("r").count().where(F.col("count") > most_edges).isEmpty():
                break
            lower, least = tagged.agg(F.percentile_approx("w", 0.5, 10_000), F.min("w")).first()
            if t == least:
                event = True
                break
            t = lower if lower < t else least
            s.drop(root, tagged)
        if event:
            out = _one_event(root, comp, gains, t, eps)
        else:
            null = lambda ty: F.lit(None).cast(ty)
            kind = lambda k: F.lit(k).cast("byte").alias("kind")
            rows = tagged.select("r", kind(EDGE_ROW), F.col("u").alias("a"), F.col("v").alias("b"), "w", null("long").alias("size"), null("long").alias("node"), null("double").alias("s1"), null("double").alias("below"))
            rows = rows.unionByName(comp.join(root, "c").select("r", kind(COMPONENT), F.col("c").alias("a"), null("long").alias("b"), null("double").alias("w"), "size", "node", "s1", "below"))
            later = gains.where("node % 2 <> 0").withColumn("base", F.shiftright("node", 1)).join(where, "base").join(root, "c")
            rows = rows.unionByName(later.select("r", kind(GAIN), F.col("base").alias("a"), null("long").alias("b"), null("double").alias("w"), F.col("n").alias("size"), "node", F.col("d").alias("s1"), null("double").alias("below")))
            out = rows.repartition(max(8, -(-left // most_edges)), "r").mapInArrow(_join_up(eps), STEP_OUT)
        out = s.put(out, "step")
        new = out.where(f"kind = {ALIVE}").select(F.col("a").alias("c"), "size", F.col("b").alias("node"), F.col("x").alias("s1"), "below")
        comp = s.put(comp.join(root, "c", "left_anti").unionByName(new), "components")
        closed = closed.unionByName(out.where(f"kind = {CLOSED}").select(F.col("a").alias("node"), F.col("b").alias("parent"), F.col("x").alias("own"), "size", "self", "w"))
        where = s.put(where.join(root, "c", "left").select("base", F.coalesce("r", "c").alias("c")), "where")
        if t is None:
            break
        e = s.put(e.where(F.col("w") > t).join(root.toDF("u", "ru"), "u", "left").join(root.toDF("v", "rv"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"), "w"), "order")
        left = e.count()
    return comp, closed


def _nodes_of(s: Scratch, placed: DataFrame, closed: DataFrame) -> DataFrame:
    """(id, node, w): the node that is open at the weight at which a vertex came into its base: at or above the base's own.

    By steps of halving length along the nodes' parents, so in as many rounds as the binary logarithm of the depth.
    """
    up = [s.put(closed.select("node", "parent", F.col("w").alias("end")), "up")]  # end: the weight at which the last node passed ends
    while True:
        u = up[-1]
        nxt = s.put(u.join(u.toDF("parent", "next", "end2"), "parent").select("node", F.col("next").alias("parent"), F.col("end2").alias("end")), "up")
        if nxt.isEmpty():
            break
        up.append(nxt)
    at = placed.select("id", (F.col("base") * 2).alias("node"), "w")
    first = up[0].select("node", "end")
    at = s.put(at.join(first, "node", "left").select("id", "node", "w", (F.coalesce("end", F.lit(float("inf"))) <= F.col("w")).alias("on")), "at")
    still = at.where("not on").select("id", "node", "w")
    go = at.where("on").select("id", "node", "w")
    for u in reversed(up):
        go = s.put(go.join(u, "node", "left").select("id", F.when(F.col("end") <= F.col("w"), F.col("parent")).otherwise(F.col("node")).alias("node"), "w"), "at")
    return s.put(still.unionByName(go), "at")


def _nodes_in_tasks(placed: DataFrame, closed: DataFrame) -> DataFrame:
    """_nodes_of where there are few closed nodes: all tasks get them."""
    got = closed.select("node", "parent", "w").toArrow()
    node, to, w = (got.column(c).to_numpy() for c in ("node", "parent", "w"))
    names, inv = np.unique(np.r_[node, to], return_inverse=True)
    up, end = np.arange(len(names)), np.full(len(names), np.inf)
    up[inv[: len(node)]], end[inv[: len(node)]] = inv[len(node) :], w
    tree = placed.sparkSession.sparkContext.broadcast((names, up, end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, up, end = tree.value
        steps = [(up, end)]
        while len(names) and np.isfinite(steps[-1][1][steps[-1][0]]).any():
            u, e = steps[-1]
            steps.append((u[u], e[u]))
        for b in batches:
            node, w = b.column("base").to_numpy() * 2, b.column("w").to_numpy()
            at = np.searchsorted(names, node)
            k = np.flatnonzero(names[np.minimum(at, len(names) - 1)] == node) if len(names) else np.empty(0, int)
            at, wk = at[k], w[k]
            for u, e in reversed(steps):
                at = np.where(e[at] <= wk, u[at], at)
            node[k] = names[at]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(node), b.column("w")], ["id", "node", "w"])

    return placed.select("id", "base", "w").mapInArrow(run, "id long, node long, w double")


def hierarchy(s: Scratch, forest: DataFrame, min_cluster_size: int, end: float, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """The condensed hierarchy of a spanning forest (a, b, w), up to the weight ``end``.

    Returns nodes (node, parent, own, size, self, component) and vertices (id, component, node, density). From the
    smallest weights up, components join along the edges. One that reaches min_cluster_size is a node of the
    condensed tree, which goes on while it only gains smaller components; two or more that join make a new node. own is
    the node's stability, the sum over its vertices of the density (1 / weight) at which each came in less that at which
    the node ended; self says that it is at least as stable as the best choice below it. A vertex has the node that it
    came into and the density at which it did, none if it never was in a component of min_cluster_size. component, of
    vertices without a node and of nodes without a parent, is what ``end`` leaves, named after one of its vertices.

    First each vertex gets its base, which leaves a small tree of bases; its merges say which node each vertex came into,
    and once these are summed up, the merges are gone through again for the stabilities.
    """
    eps = end / 1000
    placed, alone, core = bases(s, forest, min_cluster_size, most_edges)
    base = s.put(placed.select(F.col("base").alias("c")).distinct(), "bases")
    start = base.select("c", F.lit(1).cast("long").alias("size"), (F.col("c") * 2).alias("node"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("below"))
    none = forest.sparkSession.createDataFrame([], "node long, n long, d double")
    closed = s.put(_merged(s, core, start, none, eps, most_edges)[1], "merges")
    few = closed.count() <= communities.IN_ONE_TASK
    at = (s.put(_nodes_in_tasks(placed, closed), "at") if few else _nodes_of(s, placed, closed)).withColumn("density", 1.0 / (F.col("w") + eps))
    gains = s.put(at.groupBy("node").agg(F.count("*").alias("n"), F.sum("density").alias("d")), "gains")
    start = s.put(start.select("c", "node", "below").join(gains, "node").select("c", F.col("n").alias("size"), "node", F.col("d").alias("s1"), "below"), "start")
    comp, closed = _merged(s, core, start, gains, eps, most_edges)
    own = F.col("s1") - F.col("size") / (end + eps)
    nodes = comp.select("node", F.lit(None).cast("long").alias("parent"), own.alias("own"), "size", (own >= F.col("below")).alias("self"), F.col("c").alias("component"))
    nodes = nodes.unionByName(closed.drop("w").withColumn("component", F.lit(None).cast("long")))
    vertices = alone.select("id", "component", F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("density"))
    vertices = vertices.unionByName(at.select("id", F.lit(None).cast("long").alias("component"), "node", "density"))
    return s.put(nodes, "tree"), s.put(vertices, "placed")


def _climb(s: Scratch, nodes: DataFrame) -> DataFrame:
    """(node, root, chosen): the root above each node, and the topmost node at or above it that is chosen for its stability.

    By pointer doubling: as many rounds as the binary logarithm of the tree's depth.
    """
    p = s.put(nodes.select("node", F.col("parent").alias("ptr"), F.coalesce("parent", "node").alias("root"), F.when(F.col("self"), F.col("node")).alias("chosen")), "climb")
    while not p.where("ptr is not null").isEmpty():
        up = p.select(F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("root").alias("root2"), F.col("chosen").alias("chosen2"))
        nxt = s.put(p.join(up, "ptr", "left").select("node", F.col("ptr2").alias("ptr"), F.coalesce("root2", "root").alias("root"), F.coalesce("chosen2", "chosen").alias("chosen")), "climb")
        s.drop(p)
        p = nxt
    return p.select("node", "root", "chosen")


def flat_cut(s: Scratch, nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, component): what the hierarchy's end leaves connected, whatever its size."""
    at = _climb(s, nodes).select("node", "root").join(nodes.select(F.col("node").alias("root"), F.col("component").alias("top")), "root").select("node", "top")
    return vertices.join(at, "node", "left").select("id", F.coalesce("component", "top").alias("component"))


def groups_of_anchors(cells: DataFrame, anchors: DataFrame, dim: int, step: float, scratch: Scratch | None = None) -> DataFrame:
    """(cell_id, anchor_id): cells that can be reached from an anchor in steps of at most ``step``, once each.

    Anchors take part as vertices of the graph; the flat cut of the condensed hierarchy at ``step`` gives the groups.
    Anchors without a valid vector have no group.
    """
    s = scratch or Scratch(cells.sparkSession, "density")
    both = cells.select(F.col("cell_id") * 2 + F.lit(0), "x_pca").toDF("id", "v").unionAll(anchors.select(F.col("anchor_id") * 2 + 1, "x_pca").toDF("id", "v"))
    forest, _ = spanning_forest(both, "id", "v", dim, step, scratch=s)
    comp = s.put(flat_cut(s, *hierarchy(s, forest, MIN_CLUSTER, step)), "groups")
    a = comp.where("id % 2 <> 0").select("component", F.expr("(id - 1) div 2").alias("anchor_id"))
    c = comp.where("id % 2 = 0").select("component", F.expr("id div 2").alias("cell_id"))
    return c.join(F.broadcast(a) if a.count() <= MOST_ANCHORS else a, "component").select("cell_id", "anchor_id")


def condensed(s: Scratch, forest: DataFrame, min_cluster_size: int, end: float, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """Clusters of a spanning forest by stability: (cluster, size, stability) and (id, cluster, persistence).

    A node of the condensed hierarchy is chosen if it is at least as stable as the chosen ones below it together, and
    nothing above it is. A member's persistence is the density at which it came into a component of
    min_cluster_size; vertices that came into none, or into one above all chosen, have no cluster.
    """
    nodes, vertices = hierarchy(s, forest, min_cluster_size, end, most_edges)
    top = s.put(_climb(s, nodes).where("chosen is not null").select("node", F.col("chosen").alias("cluster")), "chosen")
    c = nodes.join(top.select(F.col("cluster").alias("node")).distinct(), "node").select(F.col("node").alias("cluster"), "size", F.col("own").alias("stability"))
    return c, vertices.join(top, "node").select("id", "cluster", F.col("density").alias("persistence"))


def cluster(df: DataFrame, id_col: str, vec: str, dim: int, radius: float, min_samples: int = 5, min_cluster_size: int = MIN_CLUSTER, exemplars: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """(cluster, size, stability, exemplars): each cluster with its size and its most persistent members, smallest ids first."""
    s = scratch or Scratch(df.sparkSession, "density")
    forest, _ = spanning_forest(df, id_col, vec, dim, radius, min_samples, scratch=s)
    c, members = condensed(s, s.put(forest, "forest"), min_cluster_size, radius)
    w = W.partitionBy("cluster").orderBy(F.desc("persistence"), "id")
    top = members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= exemplars).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("exemplars"))
    return c.join(top, "cluster")
