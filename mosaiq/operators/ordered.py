"""Order-dependent values without gathering a key in one task.

A window partitioned by a key puts all rows of the key into one task. Here the rows are range-partitioned by key
and order, so that a hot key spans many partitions; each partition is worked on its own, and one row per
partition carries the state across the borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.session import Scratch


def ranged(scratch: Scratch, df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """The rows as a written table range-partitioned by ``cols``, with the partition's number as _pid."""
    return scratch.put(df.repartitionByRange(*[F.col(c) for c in cols]).withColumn("_pid", F.spark_partition_id()), name)


def carry_last(scratch: Scratch, df: DataFrame, keys: list[str], order: list[str], value: str, out: str, inclusive: bool = False) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of earlier rows (with ``inclusive`` also of the row itself) of the key.

    ``order`` must be unique within a key. Null keys form a key of their own.
    """
    b = ranged(scratch, df, [*keys, *order], out)
    w = W.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    k = F.struct(*keys)
    ends = b.groupBy("_pid").agg(F.min(k).alias("head"), F.max(k).alias("tail"))
    last = b.join(F.broadcast(ends), "_pid").where(k.eqNullSafe(F.col("tail")) & F.col(value).isNotNull())  # one row per partition
    last = last.groupBy("_pid").agg(F.max_by(value, F.struct(*order)).alias("v"))
    marks = ends.join(last, "_pid", "left").select("_pid", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("head").alias("key"), F.lit(None).alias("v")), F.struct(F.lit(1).alias("kind"), F.col("tail").alias("key"), F.col("v").alias("v")))).alias("m")).select("_pid", "m.*")
    wm = W.partitionBy("key").orderBy("_pid", "kind").rowsBetween(W.unboundedPreceding, -1)
    carry = marks.withColumn("_carry", F.last("v", True).over(wm)).where("kind = 0").select("_pid", F.col("key").alias("_key"), "_carry")
    local = b.withColumn(out, F.last(value, True).over(w))
    r = local.withColumnRenamed("_pid", "_p").join(F.broadcast(carry), (F.col("_p") == F.col("_pid")) & k.eqNullSafe(F.col("_key")), "left")
    return r.withColumn(out, F.coalesce(out, "_carry")).select(*df.columns, out)


def running_sum(scratch: Scratch, df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the key, 0 for its first row. ``order`` must be unique."""
    b = ranged(scratch, df, [*keys, *order], out)
    w = W.partitionBy("_pid", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = b.groupBy("_pid", *keys).agg(F.sum(value).alias("_s"))
    # a key that ends within a partition needs no carry beyond it: only the first and last key of a partition matter
    k = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_"))
    ends = sums.groupBy("_pid").agg(F.max_by("_s", k).alias("_s"), F.max(k).alias("tail"), F.min(k).alias("head"))
    marks = ends.select("_pid", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("head").alias("key"), F.lit(0).cast("long").alias("v")), F.struct(F.lit(1).alias("kind"), F.col("tail").alias("key"), F.col("_s").alias("v")))).alias("m")).select("_pid", "m.*")
    wm = W.partitionBy("key").orderBy("_pid", "kind").rowsBetween(W.unboundedPreceding, -1)
    carry = marks.withColumn("_carry", F.sum("v").over(wm)).where("kind = 0").select("_pid", F.col("key").alias("_key"), "_carry")
    local = b.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))
    r = local.withColumnRenamed("_pid", "_p").join(F.broadcast(carry), (F.col("_p") == F.col("_pid")) & k.eqNullSafe(F.col("_key")), "left")
    return r.withColumn(out, F.col(out) + F.coalesce("_carry", F.lit(0))).select(*df.columns, out)


def rank(scratch: Scratch, df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the place of each row in its key, from 0. ``order`` must be unique."""
    return running_sum(scratch, df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", out).drop("_one")
