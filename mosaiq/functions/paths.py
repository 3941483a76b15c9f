"""Path metadata as Column expressions.

Every function takes and returns Columns, so the work stays in generated code and can be pushed
into any scan or join. Result paths look like ``<base>/<algorithm folder>/<parameter folders>/<section>.<ext>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that occur in algorithm folders.
DATA_TYPES = ("Raw", "PCA15", "PCA50", "SCVI", "Log1p")
DISTANCES = ("Correlation", "Euclidean", "Cosine")

# The resolution grid, 10 to the powers -1 .. 2.5 in 50 steps.
GRID = {"log_min": -1.0, "log_max": 2.5, "n": 50}

_BASE = rf"({'|'.join(DATA_TYPES)}|LocalfreqW?(?:Pca\d+)?K\d+)({'|'.join(DISTANCES)})?"


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row.

    Catalyst would copy an expression into each place that reads it; a generator of one row keeps it in one.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def _int(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{1,18}$"), c.try_cast("bigint"))


def _group(c: Column, pattern: str, i: int = 1) -> Column:
    """Group i of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def resolve_parts(path: Column) -> Column:
    """The folders and file of a path as an array, with empty parts and ``.`` left out and ``..`` followed."""
    step = lambda acc, p: (
        F.when(p.isin("", "."), acc)
        .when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1))
        .when(p == "..", acc)
        .otherwise(F.concat(acc, F.array(p)))
    )
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def section_of(file_name: Column) -> Column:
    """The file name without all its extensions. A section itself ends in a dot and two digits."""
    exact = _group(file_name, r"^(.+?\.\d{2})(?:\.[^/]*)?$")
    return F.coalesce(exact, F.regexp_replace(file_name, r"(\.(npy|npz|score|bak))+$", ""))


def grid_value(idx: Column, log_min=GRID["log_min"], log_max=GRID["log_max"], n=GRID["n"]) -> Column:
    """Value of the logarithmic resolution grid at an index."""
    return F.pow(F.lit(10.0), F.lit(log_min) + F.lit(log_max - log_min) * idx / F.lit(float(n - 1)))


def parse_parts(parts: Column) -> Column:
    """Metadata of the parts of a relative path (algorithm folder first, file last) as a struct.

    Null if there are fewer than two parts. Unknown algorithms keep their folder name as method.
    """
    from mosaiq.functions.grids import data_type_of_token

    algo, folders, name = F.get(parts, F.lit(0)), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), F.element_at(parts, -1)
    leiden, pheno = algo.startswith("Leiden"), algo.startswith("PhenoGraph")
    kmeans, lda = algo.rlike("^[Kk]means"), algo.startswith("LDA")
    pre = algo.rlike("^(Preexisting|Allen)_")
    known = leiden | pheno | kmeans | lda | pre

    env = leiden & algo.contains("_envenv")
    base = F.when(leiden, F.substring_index(algo, "_envenv", 1)).otherwise(algo)
    named = rf"^(?:Leiden|PhenoGraph){_BASE}"
    pca = F.when(F.lower(algo).contains("pca15"), "pca15").when(F.lower(algo).contains("pca50"), "pca50")

    first_res = F.replace(F.get(F.filter(folders, lambda p: p.startswith("res_")), F.lit(0)), F.lit("res_"), F.lit(""))
    value_form = first_res.contains("p")
    folder_value = F.when(value_form, F.replace(first_res, F.lit("p"), F.lit(".")).try_cast("double"))
    folder_idx = F.when(~value_form, _int(first_res))
    name_idx = _int(_group(algo, r"_res_(\d+)"))

    ks = F.filter(F.transform(F.filter(folders, lambda p: p.startswith("k_")), lambda p: _int(F.replace(p, F.lit("k_"), F.lit("")))), lambda v: v.isNotNull())
    first_k = _int(F.replace(F.get(F.filter(folders, lambda p: p.startswith("k_")), F.lit(0)), F.lit("k_"), F.lit("")))
    env_ks = F.filter(F.transform(F.filter(folders, lambda p: p.startswith("env_k_")), lambda p: _int(F.replace(p, F.lit("env_k_"), F.lit("")))), lambda v: v.isNotNull())
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    at = lambda a, i: F.get(a, F.lit(i))

    resolution = F.when(leiden, folder_value).when(pheno & name_idx.isNull(), folder_value)
    idx = (
        F.when(leiden, F.coalesce(folder_idx, F.when(folder_value.isNull(), name_idx)))
        .when(pheno, F.coalesce(name_idx, folder_idx))
        .when(~known, folder_idx)
    )
    env_k = (
        F.when(env, _int(_group(algo, r"_k_(\d+)")))
        .when(kmeans, _int(F.coalesce(_group(algo, r"(?i)env_k_(\d+)"), _group(algo, r"_k_(\d+)"))))
        .when(lda, at(ks, 0))
        .when(~known, last(env_ks))
    )
    s = F.struct(
        F.when(leiden, "leiden").when(pheno, "phenograph").when(kmeans, "kmeans").when(lda, "lda").when(pre, "preexisting").otherwise(F.lower(algo)).alias("method"),
        section_of(name).alias("section"),
        F.when(env | kmeans | lda, "env").otherwise("celltype").alias("feature_type"),
        F.when(leiden | pheno, data_type_of_token(_group(base, named, 1))).when(kmeans, F.coalesce(pca, F.lit("raw"))).when(lda, "raw").alias("data_type"),
        F.when(leiden | pheno, F.lower(_group(base, named, 2))).alias("distance"),
        env_k.alias("env_k"),
        (env & algo.contains("_w_")).alias("weighted"),
        idx.alias("resolution_idx"),
        resolution.alias("resolution"),
        F.when(kmeans, first_k).when(lda, at(ks, 1)).when(~known, last(ks)).alias("clustering_k"),
        F.when(pre, F.regexp_replace(algo, "^(Preexisting|Allen)_", "")).alias("annotation_level"),
        algo.alias("algorithm_string"),
    )
    return F.when(F.size(parts) >= 2, s)


def parse_path(path: Column, base: str = "") -> Column:
    """Metadata of a path below ``base`` as a struct; null where the path is null or too short."""
    rel = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path) if base else path
    return parse_parts(resolve_parts(rel))


def same_configuration(meta: Column) -> Column:
    """A key that is equal for path forms of one configuration.

    A resolution index of the grid counts as the grid's value; values are taken to three decimals. Where the
    folder names no known data type, the folder name itself is part of the key.
    """
    res = F.when(meta["resolution"].isNotNull(), F.format_string("%.3f", meta["resolution"])).when(
        meta["resolution_idx"].between(0, GRID["n"] - 1), F.format_string("%.3f", grid_value(meta["resolution_idx"]))
    ).otherwise(F.concat(F.lit("idx"), meta["resolution_idx"].cast("string")))
    odd = F.when(meta["method"].isin("leiden", "phenograph") & (meta["data_type"].isNull() | meta["distance"].isNull()), meta["algorithm_string"])
    fields = [meta[f].cast("string") for f in ("method", "feature_type", "data_type", "distance", "env_k", "weighted", "clustering_k", "annotation_level")]
    return F.concat_ws("|", *[F.coalesce(f, F.lit("-")) for f in (*fields, res, odd)])


def run_parts(parts: Column) -> Column:
    """Struct of the run's number and the parts below the last folder ``run_<number>``; nulls if there is none."""
    hits = F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(r"^run_\d{1,18}$"), i + 1)), lambda i: i.isNotNull())
    i = F.when(F.size(hits) > 0, F.element_at(hits, -1))
    return F.struct(
        F.substr(F.get(parts, i - 1), F.lit(5)).try_cast("bigint").alias("run"),
        F.when(i < F.size(parts), F.slice(parts, i + 1, F.greatest(F.size(parts) - i, F.lit(1)))).alias("parts"),
    )


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def score_text(text: Column) -> Column:
    """Struct (raw, normalized) of a score file's text; null where the text is none of the three layouts.

    Layouts: ``raw``, ``raw TAB normalized``, four TAB fields with raw last. NaN and infinity are no scores.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    f = F.transform(F.split(strip(text), "\t"), strip)
    num = lambda c: F.when(c.rlike(_NUMBER), c.try_cast("double"))
    n = F.size(f)
    raw = F.when(n == 4, num(F.get(f, F.lit(3)))).when(n.isin(1, 2), num(F.get(f, F.lit(0))))
    norm = F.when(n == 2, num(F.get(f, F.lit(1))))
    ok = raw.isNotNull() & ((n != 2) | norm.isNotNull())
    return F.when(ok, F.struct(raw.alias("raw"), norm.alias("normalized")))


def legacy_columns(m: Column) -> list[Column]:
    """The older flat form of parsed metadata: texts for numbers, capitalised names, 0 as null."""
    text = lambda c: F.nullif(c, F.lit(0)).cast("string")
    return [
        m["algorithm_string"].alias("algorithm"),
        F.when(m["method"] == "preexisting", F.concat(F.lit("Preexisting_"), m["annotation_level"])).otherwise(F.initcap(m["method"])).alias("method"),
        F.upper(m["data_type"]).alias("data_type"),
        F.initcap(m["distance"]).alias("distance"),
        F.when(m["feature_type"] == "env", "envenv").alias("env_type"),
        m["weighted"].alias("weighted"),
        text(m["env_k"]).alias("algorithm_k"),
        text(m["env_k"]).alias("env_k"),
        F.coalesce(text(m["clustering_k"]), m["resolution_idx"].cast("string")).alias("clustering_k"),
        m["resolution"].alias("resolution"),
        m["section"].alias("section_name"),
    ]


def build_path(m: Column, extension: str = ".npy") -> Column:
    """Relative path of parsed metadata, the inverse of parse_path up to older spellings."""
    from mosaiq.functions.grids import folder_name, resolution_dirname

    algo = F.when(m["method"] == "preexisting", F.concat(F.lit("Preexisting_"), m["annotation_level"])).otherwise(folder_name(m["method"], m["data_type"], m["distance"], m["env_k"], m["weighted"]))
    res = F.coalesce(resolution_dirname(m["resolution"]), F.concat(F.lit("res_"), m["resolution_idx"].cast("string")))
    k = lambda c: F.concat(F.lit("k_"), c.cast("string"))
    mid = F.when(m["method"] == "lda", F.concat_ws("/", k(m["env_k"]), k(m["clustering_k"]))).when(m["method"] == "kmeans", k(m["clustering_k"])).when(m["method"].isin("leiden", "phenograph"), res)
    return F.concat_ws("/", algo, mid, F.concat(m["section"], F.lit(extension)))


def label_folder(columns: list[str]) -> Column:
    """Folder of a configuration's labels below its algorithm's: by resolution, else by index, else by clustering_k.

    The algorithm is algorithm_string where that is given, else algorithm. Columns that a table lacks count as null.
    """
    from mosaiq.functions.grids import resolution_dirname

    col = lambda c, t: F.col(c).cast(t) if c in columns else F.lit(None).cast(t)
    named = lambda head, c: F.concat(F.lit(head), col(c, "bigint").cast("string"))
    sub = F.coalesce(resolution_dirname(col("resolution", "double")), named("res_", "resolution_idx"), named("k_", "clustering_k"))
    return F.concat_ws("/", F.coalesce(col("algorithm_string", "string"), col("algorithm", "string")), sub)
