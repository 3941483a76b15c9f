"""Numeric vectors as Arrow batches, and a forest of random splits that brings near vectors together.

The forest is fitted on a bounded sample, but every row is routed through it. It only decides which rows meet;
distances are always those of the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 40_000  # rows on which the upper splits of a forest are fitted, at most
PER_LEAF = 4_096  # rows on which the splits below one of its leaves are fitted, on average
TASK_ROWS = 60_000  # rows that meet in one task, on average


def unpack(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(valid, vectors): which rows hold a full vector without null or NaN, and those vectors as float32."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy()
    n = np.diff(off)
    ok = (n == dim) & ~np.asarray(col.is_null())
    values = np.asarray(col.values.to_numpy(zero_copy_only=False), dtype=np.float32)
    x = values[off[:-1][ok][:, None] + np.arange(dim)] if ok.any() else np.empty((0, dim), np.float32)
    good = np.isfinite(x).all(1)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, x[good]


def valid(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """The rows that unpack takes for valid."""
    big = F.lit(float(np.finfo(np.float32).max))
    return df.where((F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) <= big)))


def to_binary(x: np.ndarray) -> pa.Array:
    """Vectors as a binary column."""
    x = np.ascontiguousarray(x, np.float32)
    width = x.shape[1] * 4
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])


def from_binary(col: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a binary column without nulls."""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return raw[off[0] : off[-1]].view(np.float32).reshape(-1, dim) if len(col) else np.empty((0, dim), np.float32)


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of a task as a table of one chunk per column."""
    b = [x for x in batches if x.num_rows]
    return pa.Table.from_batches(b).combine_chunks() if b else None


def split_at(p: np.ndarray) -> float:
    """A split of a node's projections: the widest gap among the middle third, so that near vectors stay together."""
    p = np.sort(p)
    a, b = len(p) // 3, max(len(p) - len(p) // 3, len(p) // 3 + 2)
    mid = p[a:b]
    if len(mid) < 2:
        return float(p[len(p) // 2]) if len(p) else 0.0
    i = int(np.argmax(np.diff(mid)))
    return float((mid[i] + mid[i + 1]) / 2)


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int | list[int]) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each tree one direction per level, and one threshold per node of the level."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(trees):
        r = rng.normal(size=(sample.shape[1], max(depth, 1))).astype(np.float32)
        r /= np.linalg.norm(r, axis=0)
        p, node, thresholds = sample @ r, np.zeros(len(sample), int), []
        for level in range(depth):
            order = np.argsort(node, kind="stable")
            cuts = np.searchsorted(node[order], np.arange(2**level + 1))
            t = np.array([split_at(p[order[cuts[i] : cuts[i + 1]], level]) for i in range(2**level)], np.float32)
            node = node * 2 + (p[:, level] > t[node])
            thresholds.append(t)
        out.append((r, thresholds))
    return out


def route(x: np.ndarray, tree: tuple[np.ndarray, list[np.ndarray]]) -> np.ndarray:
    """Leaf of each vector."""
    r, thresholds = tree
    p, node = x @ r, np.zeros(len(x), np.int64)
    for level, t in enumerate(thresholds):
        node = node * 2 + (p[:, level] > t[node])
    return node


def small_groups(x: np.ndarray, rows: np.ndarray, most: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Split rows of an overfull leaf further, until at most ``most`` are together."""
    todo = [rows]
    while todo:
        g = todo.pop()
        if len(g) <= most:
            yield g
            continue
        p = x[g] @ rng.normal(size=x.shape[1]).astype(np.float32)
        right = p > split_at(p)
        if right.all() or not right.any():  # equal vectors: any split will do
            right = np.arange(len(g)) < len(g) // 2
        todo += [g[right], g[~right]]


def leaf_edges(x: np.ndarray, ids: np.ndarray, k: int, r2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, d2): for each row its k nearest others of other ids, at a squared distance of at most r2.

    Ties go to the smaller id wherever at most a few times k others are within the radius.
    """
    n = len(x)
    if n < 2:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    c = x - x.mean(0)
    sq = (c * c).sum(1)
    d = sq[:, None] + sq[None] - 2 * (c @ c.T)
    np.fill_diagonal(d, np.inf)
    limit = r2 + 1e-4 * (float(sq.max()) + 1e-6) if np.isfinite(r2) else np.inf  # float32 products; checked exactly below
    near = d <= limit
    if near.sum() > 6 * k * n and n > 2 * k + 2:
        j = np.argpartition(d, 2 * k, axis=1)[:, : 2 * k]
        i = np.repeat(np.arange(n), 2 * k)
        j = j.ravel()
        keep = near[i, j]
        i, j = i[keep], j[keep]
    else:
        i, j = np.nonzero(near)
    other = ids[i] != ids[j]
    i, j = i[other], j[other]
    e = x[i].astype(np.float64) - x[j]
    d2 = np.einsum("ij,ij->i", e, e)
    keep = d2 <= r2
    i, j, d2 = i[keep], j[keep], d2[keep]
    order = np.lexsort((ids[j], d2, i))
    i, j, d2 = i[order], j[order], d2[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    return i[keep], j[keep], d2[keep]


def sample_vectors(df: DataFrame, vec: str, dim: int, rows: int, seed: int, most: int = SAMPLE) -> np.ndarray:
    """At most ``most`` valid vectors."""
    share = min(1.0, 1.2 * most / max(rows, 1))
    got = df.select(F.col(f"`{vec}`").alias("v")).where(F.size("v") == dim)
    got = (got.sample(False, share, seed) if share < 1 else got).limit(most).toArrow()
    return unpack(got.column("v"), dim)[1] if got.num_rows else np.empty((0, dim), np.float32)


def fit_below(src: DataFrame, forest: list, top: int, extra: int, dim: int, rows: int, per_leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits below the leaves of a forest, each fitted on the sampled rows of its leaf.

    Returns (directions, thresholds): for each leaf of each tree one direction per further level, and its thresholds
    level by level. Their size depends on the forest's and per_leaf only, not on the rows. A leaf without sampled rows
    splits at 0.
    """
    share = min(1.0, per_leaf * 2.0**top / max(rows, 1))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = whole(batches)
        if t is None:
            return
        leaf, x = t.column("leaf").to_numpy(), from_binary(t.column("v").chunk(0), dim)
        order = np.argsort(leaf, kind="stable")
        leaf, x = leaf[order], x[order]
        cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
        fitted = [fit_forest(x[a:b], 1, extra, [seed, int(leaf[a])])[0] for a, b in zip(cuts[:-1], cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(leaf[cuts[:-1]]), pa.array([r.tobytes() for r, _ in fitted], pa.binary()), pa.array([np.concatenate(th).tobytes() for _, th in fitted], pa.binary())], ["leaf", "r", "th"])

    some = src.sample(False, share, seed) if share < 1 else src
    parts = max(8, -(-min(rows, per_leaf << top) * len(forest) // TASK_ROWS))
    got = some.mapInArrow(_spread(forest, top, dim, None), "leaf long, id long, v binary").repartition(parts, "leaf").mapInArrow(fit, "leaf long, r binary, th binary").toArrow()
    n = len(forest) << top
    r, th = np.zeros((n, dim, extra), np.float32), np.zeros((n, 2**extra - 1), np.float32)
    for leaf, a, b in zip(*(got.column(c).to_pylist() for c in ("leaf", "r", "th"))):
        r[leaf], th[leaf] = np.frombuffer(a, np.float32).reshape(dim, extra), np.frombuffer(b, np.float32)
    return r, th


def _spread(forest: list, top: int, dim: int, below):
    """Kernel: each valid row once per tree, with its leaf. ``below`` is a broadcast of fit_below's result, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = unpack(b.column("v"), dim)
            ids = b.column("id").to_numpy(zero_copy_only=False)[ok]
            v = to_binary(x)
            for t, tree in enumerate(forest):
                leaf = route(x, tree) + (t << top)
                if below is not None:
                    r, th = below.value
                    p, node = np.einsum("nd,nde->ne", x, r[leaf]), np.zeros(len(x), np.int64)
                    for level in range(p.shape[1]):
                        node = node * 2 + (p[:, level] > th[leaf, 2**level - 1 + node])
                    leaf = (leaf << p.shape[1]) + node
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(ids, pa.int64()), v], ["leaf", "id", "v"])

    return run


def grouped(df: DataFrame, id_col: str, vec: str, dim: int, rows: int, trees: int, leaf: int, seed: int, sample_rows: int = SAMPLE, per_leaf: int = PER_LEAF) -> DataFrame:
    """(leaf, id, v): each valid row once per tree, with its leaf, hash-partitioned by leaf. v is binary.

    The depth follows from the rows, so that leaves don't grow with them: levels that a sample of ``sample_rows`` can't
    tell apart are fitted below each leaf, on ``per_leaf`` rows of it.
    """
    depth = max(0, int(np.ceil(np.log2(max(rows, 1) / leaf)))) if rows > leaf else 0
    sample = sample_vectors(df, vec, dim, rows, seed, sample_rows)
    top = min(depth, int(np.log2(max(len(sample) / 8, 1))))
    forest = fit_forest(sample, trees, top, seed)
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec}`").alias("v")).where("id is not null and v is not null")
    extra = min(depth - top, int(np.log2(max(per_leaf / 8, 1))))
    below = df.sparkSession.sparkContext.broadcast(fit_below(src, forest, top, extra, dim, rows, per_leaf, seed)) if extra > 0 else None
    parts = max(8, -(-rows * trees // TASK_ROWS))
    return src.mapInArrow(_spread(forest, top, dim, below), "leaf long, id long, v binary").repartition(parts, "leaf")


def leaves(table: pa.Table, dim: int, most: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of each leaf in a task, each id once, at most ``most`` rows together."""
    leaf = table.column("leaf").to_numpy()
    ids = table.column("id").to_numpy()
    x = from_binary(table.column("v").chunk(0), dim)
    order = np.lexsort((ids, leaf))
    leaf, ids, x = leaf[order], ids[order], x[order]
    first = np.r_[True, (leaf[1:] != leaf[:-1]) | (ids[1:] != ids[:-1])]  # repeated rows of an id
    leaf, ids, x = leaf[first], ids[first], x[first]
    cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:]):
        for g in small_groups(x, np.arange(a, b), most, np.random.default_rng([seed, int(leaf[a])])):  # other directions in each leaf
            yield ids[g], x[g]
