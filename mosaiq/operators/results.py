"""Score tables: weighted statistics, summaries, unions, progress, and pairwise comparison of labelings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONFIG = ("algorithm", "method", "data_type", "distance", "env_type", "weighted", "algorithm_k", "env_k", "clustering_k", "resolution")


def _num(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def weighted_stats(score: Column, weight: Column, name: str) -> list[Column]:
    """Weighted and unweighted mean and population standard deviation, null scores left out per column."""
    w = F.when(score.isNotNull(), weight.cast("double"))
    sw, m1, m2 = F.sum(w), F.sum(w * score), F.sum(w * score * score)
    mean = m1 / F.nullif(sw, F.lit(0.0))
    var = F.greatest(m2 / F.nullif(sw, F.lit(0.0)) - mean * mean, F.lit(0.0))
    return [mean.alias(f"{name}_weighted_mean"), F.sqrt(var).alias(f"{name}_weighted_std"), F.avg(score).alias(f"{name}_unweighted_mean"), F.stddev_pop(score).alias(f"{name}_unweighted_std")]


def reduce_scores(scores: DataFrame, section_cells: DataFrame, keys: tuple[str, ...] = CONFIG) -> DataFrame:
    """One row per configuration: weighted statistics of both scores, cell totals and section counts.

    Sections are weighted by their number of cells (section_cells: section, n_cells); scores of sections without
    cells are left out. Null keys group together; NaN counts as null.
    """
    j = scores.join(section_cells.withColumnRenamed("section", "section_name"), "section_name")
    return j.groupBy(*keys).agg(
        *weighted_stats(_num("percolation_score"), F.col("n_cells"), "raw_score"),
        *weighted_stats(_num("normalized_percolation_score"), F.col("n_cells"), "normalized_score"),
        F.sum("n_cells").alias("total_cells"),
        F.count("*").alias("n_sections"),
        F.min("n_cells").alias("min_cells_per_section"),
        F.max("n_cells").alias("max_cells_per_section"),
    )


def section_cells(cells: DataFrame) -> DataFrame:
    """(section, n_cells): distinct cells per section; cells without section are left out."""
    return cells.where("section is not null and cell_id is not null").select("section", "cell_id").distinct().groupBy("section").agg(F.count("*").alias("n_cells"))


def pooled_type_stats(labels: DataFrame, keys: tuple[str, ...] = ("config_id",)) -> DataFrame:
    """(keys, total_number_of_types, type_distribution_entropy): of labels pooled over sections, in nats.

    Null labels and -1 (no label) are left out; repeated rows count once.
    """
    n = labels.where("label >= 0").select(*keys, "section", "cell_id", "label").distinct().groupBy(*keys, "label").agg(F.count("*").alias("n"))
    g = n.groupBy(*keys).agg(F.count("*").alias("total_number_of_types"), F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return g.select(*keys, "total_number_of_types", (F.ln("t") - F.col("s") / F.col("t")).alias("type_distribution_entropy"))


def distinct_labels(labels: DataFrame) -> DataFrame:
    """One label per configuration, section and cell: the smallest of its labels that are not null or -1."""
    return labels.where("label >= 0 and config_id is not null and section is not null and cell_id is not null").groupBy("config_id", "section", "cell_id").agg(F.min("label").alias("label"))


def contingency(labels: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(config_1, config_2, a, b, n): cells that have label a in one and b in the other configuration.

    All pairs config_1 < config_2 with common cells, or those of ``pairs``. The join is on the cell, so its size is
    the number of cells times the square of labelings per cell, and no configuration is gathered.
    """
    x = labels.select("section", "cell_id", F.col("config_id").alias("config_1"), F.col("label").alias("a"))
    y = labels.select("section", "cell_id", F.col("config_id").alias("config_2"), F.col("label").alias("b"))
    j = x.join(y, ["section", "cell_id"]).where("config_1 < config_2")
    if pairs is not None:
        j = j.join(pairs.select("config_1", "config_2"), ["config_1", "config_2"])
    return j.groupBy("config_1", "config_2", "a", "b").agg(F.count("*").alias("n"))


def adjusted_rand(table: DataFrame, min_labels: int = 1) -> DataFrame:
    """(config_1, config_2, ari, n_cells, n_labels_1, n_labels_2) from a contingency table.

    ari is 1 where both partitions agree on every pair of cells, also if there is one label or one cell only.
    """
    k = ["config_1", "config_2"]
    c2 = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2.0
    i = table.groupBy(*k).agg(F.sum(c2("n")).alias("i"), F.sum("n").alias("n_cells"))
    side = lambda v, s, n: table.groupBy(*k, v).agg(F.sum("n").alias("m")).groupBy(*k).agg(F.sum(c2("m")).alias(s), F.count("*").alias(n))
    j = i.join(side("a", "sa", "n_labels_1"), k).join(side("b", "sb", "n_labels_2"), k)
    t = c2("n_cells")
    expected, top = F.col("sa") * F.col("sb") / t, (F.col("sa") + F.col("sb")) / 2.0
    same = (F.col("i") == F.col("sa")) & (F.col("i") == F.col("sb"))
    j = j.withColumn("ari", F.when(same, F.lit(1.0)).otherwise((F.col("i") - expected) / F.nullif(top - expected, F.lit(0.0))))
    return j.where((F.col("n_labels_1") >= min_labels) & (F.col("n_labels_2") >= min_labels)).select(*k, "ari", "n_cells", "n_labels_1", "n_labels_2")


def pairs_of(configs: DataFrame, key: str, id_cols: tuple[str, ...] = ()) -> DataFrame:
    """(idx_1, idx_2, key_1, key_2, id columns _1 and _2): all pairs of configurations, in order of the key."""
    c = configs.withColumn("idx", F.row_number().over(W.orderBy(key)) - 1)  # the configuration table is a small dimension
    side = lambda n: c.select(*[F.col(x).alias(f"{x}_{n}") for x in ("idx", key, *id_cols)])
    return side(1).join(side(2), F.col("idx_1") < F.col("idx_2"))


def union_chunks(required: tuple[str, ...], *chunks: DataFrame) -> DataFrame:
    """Union by name of chunks that may lack optional columns; missing required columns raise ValueError."""
    if not chunks:
        raise ValueError("no chunks")
    for c in chunks:
        if lacking := set(required) - set(c.columns):
            raise ValueError(f"chunk lacks {sorted(lacking)}")
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def progress(expected: DataFrame, existing: DataFrame, step: str = "step", path: str = "rel_path") -> DataFrame:
    """(step, expected, completed, percent) of expected outputs; a step without any is complete."""
    have = existing.select(step, path).distinct().withColumn("_have", F.lit(1))
    g = expected.select(step, path).distinct().join(have, [step, path], "left").groupBy(step).agg(F.count("*").alias("expected"), F.count("_have").alias("completed"))
    return g.withColumn("percent", F.when(F.col("expected") > 0, 100.0 * F.col("completed") / F.col("expected")).otherwise(100.0))


def pending(expected: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Expected outputs that don't exist."""
    return expected.join(existing.select(*keys).distinct(), keys, "left_anti")


def chunks(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Add ``chunk`` (from 1): contiguous slices of ``size`` rows in the given order.

    Rows are ranked within range partitions; one row per partition carries the offset, so no task sees all rows.
    """
    from mosaiq.operators.ordered import running_sum
    from mosaiq.session import Scratch

    s = Scratch(rows.sparkSession, "chunks")
    one = rows.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0))
    return running_sum(s, one, ["_all"], order, "_one", "_at").withColumn("chunk", (F.floor(F.col("_at") / size) + 1)).drop("_one", "_all", "_at")


def in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place`` (from 0) in the given order of columns, nulls last, without gathering the rows. The order must be unique."""
    from mosaiq.operators.ordered import rank
    from mosaiq.session import Scratch

    keys = [f"_o{i}" for i in range(2 * len(order))]
    d = rows
    for i, c in enumerate(order):
        d = d.withColumn(keys[2 * i], F.col(c).isNull()).withColumn(keys[2 * i + 1], F.col(c))
    return rank(Scratch(rows.sparkSession, "order"), d.withColumn("_all", F.lit(0)), ["_all"], keys, "place").drop("_all", *keys)
