"""What is around each cell: type counts and Gaussian-weighted type profiles of its nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def type_counts(knn: DataFrame, types: DataFrame) -> DataFrame:
    """(section, cell_id, type, n): neighbours (the cell included) of each type. ``types``: section, cell_id, type.

    Neighbours without a type count nowhere.
    """
    t = types.select("section", F.col("cell_id").alias("dst"), "type").where("type is not null")
    return knn.join(t, ["section", "dst"]).groupBy("section", F.col("src").alias("cell_id"), "type").agg(F.count("*").alias("n"))


def type_weights(knn: DataFrame, types: DataFrame, k: int, scale_index: int) -> DataFrame:
    """(section, cell_id, type, w): sums of exp(-d2 / h2) over neighbours of each type, the cell included.

    h is twice the distance at position min(scale_index, k - 1) of the neighbours, 0 being the cell itself, and at least
    1e-6. Local frequency uses scale_index 4, environment features 5.
    """
    at = min(scale_index, k - 1) + 1
    own = W.partitionBy("section", "src")
    ds = F.coalesce(F.max(F.when(F.col("k") == at, F.sqrt("d2"))).over(own), F.max(F.sqrt("d2")).over(own))
    h = F.greatest(F.lit(2.0) * ds, F.lit(1e-6))
    w = knn.withColumn("w", F.exp(-F.col("d2") / (h * h)))
    t = types.select("section", F.col("cell_id").alias("dst"), "type").where("type is not null")
    return w.join(t, ["section", "dst"]).groupBy("section", F.col("src").alias("cell_id"), "type").agg(F.sum("w").alias("w"))


def type_fractions(types: DataFrame) -> DataFrame:
    """(section, type, n, fraction): share of each type among a section's typed cells."""
    g = types.where("type is not null").groupBy("section", "type").agg(F.count("*").alias("n"))
    return g.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy("section")))
