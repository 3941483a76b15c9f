"""Items of varying size into containers of one capacity: bulk-synchronous best fit.

Each round, items and gaps (containers with room) are range-sorted together by size. A sweep over each sorted part
gives every gap, from the smallest up, the largest item below it that is still free: sizes form a bracket sequence,
an item opens, a gap closes. What a part leaves open is matched across parts by nesting depth, of which each
part knows its own share after a prefix sum over one row per part. So all conflicts are settled by rank, every gap
takes at most one item a round, and no part sees more than its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.session import Scratch

ITEM, GAP, MATCH = 0, 1, 2
BUNDLE_SHARE = 8  # small items are first bundled up to this part of the capacity
PART_ROWS = 50_000  # items and gaps of a sorted part, on average


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: brackets of a sorted part. Matches leave as such, the rest with its depth within the part."""
    b = [x for x in batches if x.num_rows]
    if not b:
        return
    t = pa.Table.from_batches(b).combine_chunks()
    kind, size = t.column("kind").to_numpy(), t.column("size").to_numpy()
    order = np.lexsort((kind, size))  # the part is sorted already but for the order of batches
    stack: list[int] = []
    to = np.full(len(kind), -1)
    for i in order.tolist():
        if kind[i] == ITEM:
            stack.append(i)
        elif stack:
            to[i] = stack.pop()
    g = np.flatnonzero(to >= 0)
    item, bins = t.column("item"), t.column("bin")
    took = np.zeros(len(kind), bool)
    took[g], took[to[g]] = True, True
    pid = t.column("_pid").to_numpy()[0]
    names = ["kind", "size", "gap", "item", "bin", "_pid", "n"]
    full = lambda n, x, ty: pa.array(np.full(n, x), ty)
    yield pa.RecordBatch.from_arrays([full(len(g), MATCH, pa.int32()), pa.array(size[to[g]]), pa.array(size[g]), item.take(pa.array(to[g])).combine_chunks(), bins.take(pa.array(g)).combine_chunks(), full(len(g), pid, pa.int32()), full(len(g), 0, pa.int64())], names)
    o = order[~took[order]]
    # open gaps come first and count down, open items follow and count up
    k = kind[o]
    n = np.where(k == GAP, np.cumsum(k == GAP), (k == GAP).sum() + np.cumsum(k == ITEM))
    yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(size[o]), pa.array(size[o]), item.take(pa.array(o)).combine_chunks(), bins.take(pa.array(o)).combine_chunks(), full(len(o), pid, pa.int32()), pa.array(n)], names)


SWEPT = "kind int, size long, gap long, item string, bin long, _pid int, n long"


def _bundle(most: int):
    """Kernel: consecutive small items of a part into bundles of at most ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_numpy()
            name, total, out = -1, most + 1, np.empty(len(size), np.int64)
            for i, x in enumerate(size.tolist()):
                if total + x > most:
                    name, total = i, 0
                total += x
                out[i] = name
            first = b.column("item").take(pa.array(out)) if len(size) else b.column("item")
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("size"), first], ["item", "size", "bundle"])

    return run


def pack(items: DataFrame, id_col: str, size: str, capacity: int, scratch: Scratch | None = None) -> DataFrame:
    """(id, piece, n_pieces, size, bin): every item once and whole, or in pieces if it exceeds the capacity alone.

    Pieces before the last fill a container each; the last is packed like an item. Items of size 0, or of null
    size (which counts as 0), take no room and are dealt over the containers in turn; if there are no other items
    they share one. Rows with the same id are one item, of the largest size among them. Items with a null id are left
    out. Best fit: from the largest down, each container takes the largest item it has room for.
    """
    s = scratch or Scratch(items.sparkSession, "pack")
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    d = items.select(F.col(f"`{id_col}`").alias("id"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("n")).where("id is not null")
    d = d.groupBy("id").agg(F.max("n").alias("n"))
    d = d.withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("n") / capacity).cast("int")))
    whole_pieces = F.when(F.col("n_pieces") > 1, F.sequence(F.lit(1), F.col("n_pieces") - 1)).otherwise(F.array().cast("array<int>"))
    full = d.select("id", "n_pieces", F.explode(whole_pieces).alias("piece")).withColumn("size", F.lit(capacity).cast("long"))
    last = d.select("id", "n_pieces", F.col("n_pieces").alias("piece"), (F.col("n") - (F.col("n_pieces") - 1) * F.lit(capacity).cast("long")).alias("size"))
    last = s.put(last, "items")

    # small items travel in bundles, so that rounds stay few
    most = max(1, capacity // BUNDLE_SHARE)
    real = last.where("size > 0").select(F.col("id").cast("string").alias("item"), "size")
    parts = lambda n: max(1, -(-n // PART_ROWS))
    small = real.where(F.col("size") <= most).repartitionByRange(parts(last.count()), F.col("size"), F.col("item")).sortWithinPartitions("size").mapInArrow(_bundle(most), "item string, size long, bundle string")
    bundles = s.put(small.unionByName(real.where(F.col("size") > most).withColumn("bundle", F.col("item"))), "bundles")
    start = bundles.groupBy("bundle").agg(F.sum("size").alias("size"))
    state = s.put(start.select(F.lit(ITEM).alias("kind"), "size", F.col("bundle").alias("item"), F.lit(None).cast("long").alias("bin")), "state")

    def left_over(df: DataFrame) -> dict[int, tuple[int, int, int]]:
        """By kind: how many, their total size, the smallest."""
        got = df.groupBy("kind").agg(F.count("*"), F.sum(F.when(F.col("kind") == MATCH, F.col("gap") - F.col("size")).otherwise(F.col("size"))), F.min("size")).collect()
        return {r[0]: (r[1], r[2], r[3]) for r in got}

    placed, opened = [], 0
    left = left_over(state.withColumn("gap", F.col("size")))
    while ITEM in left:
        _, total, least = left[ITEM]
        gaps = sum(left[k][1] for k in (GAP, MATCH) if k in left)
        need = -(-(total - gaps) // capacity)
        if need > 0 or MATCH not in left:  # no room, or none that any item fits into
            need = max(need, 1)
            new = items.sparkSession.range(opened, opened + need).select(F.lit(GAP).alias("kind"), F.lit(capacity).cast("long").alias("size"), F.lit(None).cast("string").alias("item"), F.col("id").alias("bin"))
            opened += need
            state = state.unionByName(new)
        state = state.where((F.col("kind") == ITEM) | (F.col("size") >= least))  # smaller gaps are done
        rows = left[ITEM][0] + sum(left[k][0] for k in (GAP, MATCH) if k in left) + max(need, 0)
        sort = state.repartitionByRange(parts(rows), F.col("size"), F.col("kind"), F.col("item"), F.col("bin")).withColumn("_pid", F.spark_partition_id())
        swept = s.put(sort.mapInArrow(_sweep, SWEPT), "swept")
        per = swept.where(f"kind <> {MATCH}").groupBy("_pid").agg(F.count_if(F.col("kind") == GAP).alias("g"), F.count_if(F.col("kind") == ITEM).alias("i"))
        before = per.withColumn("base", F.coalesce(F.sum(F.col("i") - F.col("g")).over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per part
        o = swept.where(f"kind <> {MATCH}").join(F.broadcast(before), "_pid")
        depth = F.when(F.col("kind") == GAP, F.col("base") - F.col("n") + 1).otherwise(F.col("base") - F.col("g") + F.col("n") - F.col("g"))
        w = W.partitionBy("depth").orderBy("_pid", F.col("kind").desc())
        # at a depth each part has at most one gap, then at most one item
        o = o.withColumn("depth", depth).select("kind", "size", "item", "bin", F.lag(F.struct("kind", "size", "item")).over(w).alias("was"), F.lead("kind").over(w).alias("next"))
        met = F.coalesce((F.col("kind") == GAP) & (F.col("was.kind") == ITEM), F.lit(False))
        gone = F.coalesce((F.col("kind") == ITEM) & (F.col("next") == GAP), F.lit(False))
        pick = lambda x, y: F.when(met, x).otherwise(y)
        far = o.where(~gone).select(pick(F.lit(MATCH), F.col("kind")).alias("kind"), pick(F.col("was.size"), F.col("size")).alias("size"), F.col("size").alias("gap"), pick(F.col("was.item"), F.col("item")).alias("item"), "bin")
        both = s.put(swept.where(f"kind = {MATCH}").select("kind", "size", "gap", "item", "bin").unionByName(far), "round")
        left = left_over(both)
        placed.append(both.where(f"kind = {MATCH}").select("item", "bin"))
        room = both.where(f"kind = {MATCH} and gap > size").select(F.lit(GAP).alias("kind"), (F.col("gap") - F.col("size")).alias("size"), F.lit(None).cast("string").alias("item"), "bin")
        state = both.where(f"kind <> {MATCH}").select("kind", "size", "item", "bin").unionByName(room)
        s.drop(swept)

    where = None
    for p in placed:
        where = p if where is None else where.unionByName(p)
    cols = ["id", "piece", "n_pieces", "size", "bin"]
    n_bins = max(opened, 1)
    zero = last.where("size = 0").withColumn("bin", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(n_bins)))
    out = zero.select(*cols)
    if where is not None:
        b = bundles.select("item", "bundle").join(where.withColumnRenamed("item", "bundle"), "bundle").select("item", "bin")
        out = out.unionByName(last.where("size > 0").withColumn("item", F.col("id").cast("string")).join(b, "item").select(*cols))
    # full pieces get containers of their own, numbered by a hash rank that needs no order over all
    f = full.withColumn("bin", F.monotonically_increasing_id() + n_bins).select(*cols)
    return out.unionByName(s.put(f, "full"))


def containers(packed: DataFrame, capacity: int) -> DataFrame:
    """(bin, n_items, fill, share): contents and fill of each container."""
    g = packed.groupBy("bin").agg(F.count("*").alias("n_items"), F.sum("size").alias("fill"))
    return g.withColumn("share", F.col("fill") / capacity)
