"""KMeans and LDA over feature arrays, by Spark ML."""

from __future__ import annotations

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.session import Scratch


def kmeans(df: DataFrame, vec: str, k: int, seed: int = 42, components: int | None = None) -> DataFrame:
    """(cell_id, label) by k-means|| on vectors without nulls, reduced to so many principal components first, if given."""
    if components:
        from mosaiq.operators.features import pca

        df, vec = pca(df.select("cell_id", vec), vec, components), "pca"
    v = df.select("cell_id", array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="label").fit(v).transform(v).select("cell_id", "label")


def lda(df: DataFrame, vec: str, topics: int, seed: int = 42, iterations: int = 10) -> DataFrame:
    """(cell_id, label, probabilities): topic shares and the largest topic; negative counts count as 0."""
    c = F.transform(F.col(vec), lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    v = df.select("cell_id", array_to_vector(c).alias("v"))
    m = LDA(k=topics, seed=seed, optimizer="online", maxIter=iterations, featuresCol="v").fit(v)
    p = m.transform(v).select("cell_id", vector_to_array("topicDistribution").alias("probabilities"))
    return p.select("cell_id", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int").alias("label"), "probabilities")


def kmeans_sweep(df: DataFrame, vec: str, ks: list[int], seed: int = 42, components: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(config_id, cell_id, label) for each k, config_id being ``k_<k>``. The vectors are prepared once."""
    s = scratch or Scratch(df.sparkSession, "kmeans")
    if components:
        from mosaiq.operators.features import pca

        df, vec = pca(df.select("cell_id", vec), vec, components), "pca"
    v = s.put(df.select("cell_id", vec), "vectors")
    out = None
    for k in ks:
        one = kmeans(v, vec, k, seed).select(F.lit(f"k_{k}").alias("config_id"), "cell_id", "label")
        out = one if out is None else out.unionByName(one)
    return out
