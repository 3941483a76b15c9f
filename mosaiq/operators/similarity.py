"""Neighbours in feature space, and the Jaccard graph over neighbour sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.operators import vectors

BLOCK = 1024
METRICS = ("euclidean", "cosine", "correlation")


def prepared(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors for which Euclidean order is that of the metric. Vectors of length 0 stay 0."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    x = x.astype(np.float64)
    if metric == "correlation":
        x = x - x.mean(1, keepdims=True)
    if metric != "euclidean":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n > 0, n, 1)
    return x


def _packed(df: DataFrame, id_col: str, vec: str, dim: int, metric: str) -> DataFrame:
    """(ids, v): blocks of valid vectors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = vectors.unpack(b.column("v"), dim)
            ids = b.column("id").to_numpy(zero_copy_only=False)[ok].astype(np.int64)
            x = prepared(x, metric)
            for a in range(0, len(ids), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([ids[a : a + BLOCK].tobytes()], pa.binary()), pa.array([x[a : a + BLOCK].tobytes()], pa.binary())], ["ids", "v"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v")).where("id is not null and v is not null").mapInArrow(run, "ids binary, v binary")


def query_knn(queries: DataFrame, rows: DataFrame, id_col: str, vec: str, dim: int, k: int, metric: str = "euclidean") -> DataFrame:
    """(src, dst, k, distance): exact k nearest rows of each query, its own id left out.

    Queries and rows meet in packed blocks, each pair of blocks being one matrix product; only k candidates per query
    and block go on. Distances are Euclidean, or 1 - cosine (of centred vectors for correlation). Ties go to the smaller
    id. Invalid vectors take no part; give unique ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, ri, rv in zip(*(b.column(c).to_pylist() for c in ("qi", "qv", "ri", "rv"))):
                qi, ri = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                q, r = np.frombuffer(qv).reshape(-1, dim), np.frombuffer(rv).reshape(-1, dim)
                d = (q * q).sum(1)[:, None] + (r * r).sum(1)[None] - 2 * (q @ r.T)
                d[qi[:, None] == ri[None]] = np.inf
                n = min(k + 4, d.shape[1])
                j = np.argpartition(d, n - 1, axis=1)[:, :n]
                i = np.repeat(np.arange(len(qi)), n)
                j = j.ravel()
                keep = np.isfinite(d[i, j])
                i, j = i[keep], j[keep]
                e = q[i] - r[j]
                d2 = np.einsum("ij,ij->i", e, e)
                o = np.lexsort((ri[j], d2, i))
                i, j, d2 = i[o], j[o], d2[o]
                top = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_arrays([pa.array(qi[i[top]]), pa.array(ri[j[top]]), pa.array(d2[top])], ["src", "dst", "d2"])

    q = _packed(queries, id_col, vec, dim, metric).toDF("qi", "qv")
    r = _packed(rows, id_col, vec, dim, metric).toDF("ri", "rv")
    c = q.crossJoin(r).mapInArrow(run, "src long, dst long, d2 double")  # blocks of a stated query set against all rows
    w = W.partitionBy("src").orderBy("d2", "dst")
    c = c.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
    return c.select("src", "dst", "k", (F.sqrt("d2") if metric == "euclidean" else F.col("d2") / 2.0).alias("distance"))


def feature_graph(df: DataFrame, id_col: str, vec: str, dim: int, k: int, metric: str = "euclidean", trees: int = 6, leaf: int = 512, seed: int = 42) -> DataFrame:
    """(src, dst, k, d2): approximate k nearest others of every row, from a forest of random splits.

    d2 is the squared Euclidean distance of the prepared vectors. Ties go to the smaller id.
    """
    rows = df.count()

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = vectors.unpack(b.column("v"), dim)
            x = prepared(x, metric).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), flat], ["id", "v"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = vectors.whole(batches)
        if t is None:
            return
        for ids, x in vectors.leaves(t, dim, 2 * leaf, seed):
            i, j, d2 = vectors.leaf_edges(x, ids, k, np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(d2)], ["src", "dst", "d2"])

    p = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v")).where("id is not null and v is not null").mapInArrow(prepare, "id long, v array<float>")
    g = vectors.grouped(p, "id", "v", dim, rows, trees, leaf, seed).mapInArrow(edges, "src long, dst long, d2 double").distinct()
    return g.withColumn("k", F.row_number().over(W.partitionBy("src").orderBy("d2", "dst"))).where(F.col("k") <= k).select("src", "dst", "k", "d2")


def jaccard_topk(edges: DataFrame, k: int, keep: str = "highest") -> DataFrame:
    """(src, dst, similarity, rank): for each i its k most similar 2-hop neighbours j <> i by |Ni n Nj| / |Ni u Nj|.

    Neighbour sets are out-neighbours without self and negatives. Intersections come from a join on the common
    neighbour and one aggregation. keep='lowest' keeps the least similar ones. Ties go to the smaller id.
    """
    e = edges.select("src", "dst").where("src <> dst and dst >= 0").distinct()
    deg = e.groupBy("src").agg(F.count("*").alias("n"))
    hop = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("j")), "dst").select("src", "j").where("src <> j").distinct()
    common = e.join(e.select(F.col("src").alias("j"), "dst"), "dst").where("src <> j").groupBy("src", "j").agg(F.count("*").alias("both"))
    s = hop.join(common, ["src", "j"]).join(deg, "src").join(deg.toDF("j", "m"), "j")
    s = s.withColumn("similarity", F.col("both") / (F.col("n") + F.col("m") - F.col("both")))
    o = F.desc("similarity") if keep == "highest" else F.asc("similarity")
    w = W.partitionBy("src").orderBy(o, "j")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("src", F.col("j").alias("dst"), "similarity", "rank")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): edges with their multiplicity."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("weight"))
