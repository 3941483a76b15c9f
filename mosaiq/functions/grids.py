"""Parameter grids and names as Columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def resolution_values(n: int = 50, log_min: float = -1.0, log_max: float = 2.5) -> list[float]:
    """Log-spaced resolutions."""
    return [10 ** (log_min + i * (log_max - log_min) / (n - 1)) if n > 1 else 10**log_min for i in range(n)]


def k_values(n: int = 20, lo: int = 10, hi: int = 1000) -> list[int]:
    """Distinct rounded log-spaced integers, halves to even."""
    return [int(x) for x in np.unique(np.rint(np.logspace(np.log10(lo), np.log10(hi), n)))]


def resolution_dirname(r: Column) -> Column:
    """0.1 -> res_0p100."""
    return F.when(r.isNotNull(), F.translate(F.format_string("res_%.3f", r), ".", "p"))


def data_type_token(c: Column) -> Column:
    """How a data type is written in folder names: scvi -> SCVI, pca15 -> PCA15, localfreq_w_k50 -> LocalfreqWK50, others capitalised."""
    d = F.lower(c)
    return F.when(d == "scvi", "SCVI").when(d.startswith("pca"), F.upper(c)).when(d.startswith("localfreq"), F.array_join(F.transform(F.split(d, "_"), lambda p: F.initcap(p)), "")).otherwise(F.initcap(d))


def data_type_of_token(c: Column) -> Column:
    """The inverse of data_type_token."""
    return F.lower(F.when(c.startswith("Localfreq"), F.regexp_replace(c, "(?<=.)(?=[A-Z])", "_")).otherwise(c))


def data_type_name(t: str) -> str:
    """data_type_token of one name."""
    t = t.lower()
    return "SCVI" if t == "scvi" else t.upper() if t.startswith("pca") else "".join(p.capitalize() for p in (t.split("_") if t.startswith("localfreq") else [t]))


def folder_name(method: Column, data_type: Column, distance: Column, env_k: Column, weighted: Column) -> Column:
    """Algorithm folder of a configuration, e.g. LeidenRawCorrelation_envenv_w_k_20."""
    env = F.when(env_k.isNotNull(), F.concat(F.lit("_envenv"), F.when(weighted, "_w").otherwise(""), F.lit("_k_"), env_k.cast("bigint").cast("string"))).otherwise("")
    dt, dist = F.coalesce(data_type_token(data_type), F.lit("")), F.coalesce(F.initcap(F.lower(distance)), F.lit(""))
    km = F.concat(F.lit("Kmeans"), F.when(data_type.isNotNull() & (F.lower(data_type) != "raw"), F.concat(F.lit("_"), F.lower(data_type))).otherwise(""), F.when(env_k.isNotNull(), F.concat(F.lit("_env_k_"), env_k.cast("bigint").cast("string"))).otherwise(""))
    m = F.lower(method)
    return F.when(m == "leiden", F.concat(F.lit("Leiden"), dt, dist, env)).when(m == "phenograph", F.concat(F.lit("PhenoGraph"), dt, dist)).when(m == "kmeans", km).when(m == "lda", "LDA").otherwise(method)


def derived_name(source: Column, op: Column, n: Column) -> Column:
    """Name of a derived feature: pcaN goes behind ``localfreq[_w]``, else before the last part; other ops are appended.

    localfreq_w_k50 with pca 15 -> localfreq_w_pca15_k50.
    """
    token = F.concat(op, n.cast("string"))
    parts = F.split(source, "_")
    at = F.when(parts[0] == "localfreq", F.when(F.get(parts, F.lit(1)) == "w", 3).otherwise(2)).otherwise(F.greatest(F.size(parts), F.lit(1)))
    return F.when(op == "pca", F.array_join(F.array_insert(parts, at, token), "_")).otherwise(F.concat_ws("_", source, op))


def chunk_size(seconds_per_item: Column, hours: float = 1.0, safety: float = 0.8) -> Column:
    """Items per chunk for a target time, clamped to 100..50000."""
    return F.greatest(F.lit(100), F.least(F.lit(50000), F.floor(F.lit(3600.0 * hours) / seconds_per_item * safety))).cast("int")


def duration(s: Column) -> Column:
    """Seconds as text: 42.0s, 3.5m, 1.2h."""
    return F.when(s < 60, F.format_string("%.1fs", s)).when(s < 3600, F.format_string("%.1fm", s / 60)).otherwise(F.format_string("%.1fh", s / 3600))


def glob_match(name: Column, pattern: str) -> Column:
    """Whether a name matches a shell pattern (* and ?); ``all`` matches everything."""
    if pattern in ("all", "*"):
        return F.lit(True)
    out = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in pattern)
    return name.rlike(f"^{out}$")
