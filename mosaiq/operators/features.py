"""Cell features and annotations: codes, transforms, PCA, sampling."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = ("class", "subclass", "supertype", "cluster")


def latest(cells: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """One row per cell with section and annotations: its row with the latest exported_at."""
    g = cells.where("cell_id is not null").groupBy("cell_id").agg(F.max(F.struct("exported_at", "section", *levels)).alias("r"))
    return g.select("cell_id", "r.section", *[f"r.{c}" for c in levels])


def encode_annotations(cells: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(cell_id, level, code): annotations as codes 0.. in order of their text per level, null as -1.

    Codes are ranked over the distinct values only and joined back.
    """
    long = latest(cells, levels).unpivot("cell_id", list(levels), "level", "value")
    codes = long.where("value is not null").select("level", "value").distinct()
    codes = codes.withColumn("code", (F.row_number().over(W.partitionBy("level").orderBy("value")) - 1))
    return long.join(codes, ["level", "value"], "left").select("cell_id", "level", F.coalesce("code", F.lit(-1)).alias("code"))


def encoded(cells: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """Annotation levels as labelings (config_id, section, cell_id, label), cells without section or annotation left out."""
    s = latest(cells, levels).select("cell_id", "section").where("section is not null")
    e = encode_annotations(cells, levels).where("code >= 0").join(s, "cell_id")
    return e.select(F.col("level").alias("config_id"), "section", "cell_id", F.col("code").alias("label"))


def valid(df: DataFrame, vec: str, n: int) -> DataFrame:
    """Rows with a full vector without null or NaN, one per cell_id."""
    v = F.col(vec)
    ok = (F.size(v) == n) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return df.where("cell_id is not null").where(ok).select("cell_id", vec).groupBy("cell_id").agg(F.min(vec).alias(vec))


def log1p(v: Column) -> Column:
    return F.transform(v, lambda x: F.log1p(x.cast("double")))


def standardised(df: DataFrame, vec: str, n: int) -> DataFrame:
    """(cell_id, vec): each position centred and scaled by its population standard deviation; constant positions give 0."""
    m = df.agg(*[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(n)], *[F.stddev_pop(F.col(vec)[i]).alias(f"s{i}") for i in range(n)])
    z = [F.when(F.col(f"s{i}") > 0, (F.col(vec)[i] - F.col(f"m{i}")) / F.col(f"s{i}")).otherwise(0.0) for i in range(n)]
    return df.crossJoin(F.broadcast(m)).select("cell_id", F.array(*z).alias(vec))  # one row of statistics


def pca(df: DataFrame, vec: str, k: int, standardise: bool = True) -> DataFrame:
    """(cell_id, pca): scores on the first k principal components of centred (and scaled) vectors."""
    v = df.select("cell_id", array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    v = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=standardise).fit(v).transform(v)
    return PCA(k=k, inputCol="z", outputCol="p").fit(v).transform(v).select("cell_id", vector_to_array("p").alias("pca"))


def extract(df: DataFrame, kind: str, n: int = 8) -> DataFrame:
    """Features by name: raw, log1p, pca, pcaN, scvi (case is ignored). Other names raise ValueError.

    An existing x_pca column is cut to its first N numbers; otherwise counts are log-transformed and reduced. scvi
    needs the column x_scvi.
    """
    k = kind.lower()
    if k == "raw":
        return df.select("cell_id", F.col("features").cast("array<float>").alias("features"))
    if k == "log1p":
        return df.select("cell_id", log1p(F.col("features")).alias("features"))
    if k == "scvi":
        return df.select("cell_id", F.col("x_scvi").alias("features"))
    if k.startswith("pca") and (k[3:].isdigit() or k == "pca"):
        m = int(k[3:] or 50)
        if "x_pca" in df.columns:
            return df.select("cell_id", F.slice("x_pca", 1, m).alias("features"))
        return pca(df.select("cell_id", log1p(F.col("features")).alias("features")), "features", min(m, n)).withColumnRenamed("pca", "features")
    raise ValueError(f"unknown feature type: {kind}")


def subsample(cells: DataFrame, sections: int, per_section: int, seed: int = 42) -> DataFrame:
    """(section, cell_id): the first sections by name, of each at most per_section cells in order of md5(seed|id)."""
    first = cells.where("section is not null").select("section").distinct().orderBy("section").limit(sections)
    c = cells.where("cell_id is not null").join(first, "section").select("section", "cell_id").distinct()
    w = W.partitionBy("section").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("cell_id").cast("string"))), "cell_id")
    return c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_section).select("section", "cell_id")


SECTION_COLUMNS = ("brain_section_label", "section", "Section", "sample", "batch")  # in order of preference


def section_column(df: DataFrame, wanted: str | None = None) -> str | None:
    """The column that holds the section: the wanted one, else the first usual name there is. A wanted one that lacks raises ValueError."""
    if wanted:
        if wanted not in df.columns:
            raise ValueError(f"no column {wanted}")
        return wanted
    return next((c for c in SECTION_COLUMNS if c in df.columns), None)


def for_clustering(df: DataFrame, kind: str, n: int = 8, wanted: str | None = None) -> DataFrame:
    """(cell_id, section, features): features by name with the section of each cell, "0" where none is known."""
    c = section_column(df, wanted)
    s = df.groupBy("cell_id").agg((F.min(F.col(f"`{c}`").cast("string")) if c else F.lit(None).cast("string")).alias("section"))
    return extract(df, kind, n).join(s, "cell_id", "left").select("cell_id", F.coalesce("section", F.lit("0")).alias("section"), "features")


def derive(df: DataFrame, operation: str, n: int = 50, standardise: bool = True) -> DataFrame:
    """(cell_id, features) of a derived operation on features: pca (n components), log1p, standardise. Others raise ValueError."""
    if operation == "pca":
        return pca(df, "features", n, standardise).withColumnRenamed("pca", "features")
    if operation == "log1p":
        return df.select("cell_id", log1p(F.col("features")).alias("features"))
    if operation == "standardise":
        m = df.select(F.size("features").alias("n")).where("n > 0").first()
        return standardised(df, "features", m["n"] if m else 0)
    raise ValueError(f"unknown operation: {operation}")
