"""Queries of problems 3, 5, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.llm import density, languages, mixing, neighbours, packing
from mosaiq.session import table

# (column, numbers, largest distance that counts as the same)
SPACES = (("x_pca", 15, 0.02), ("x_scvi", 16, 0.25))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "cell_expression")
    out = None
    for space, dim, radius in SPACES:
        p = neighbours.near_pairs(cells, "cell_id", space, dim, radius, trees=4, leaf=640)
        p = p.select(F.lit(space).alias("space"), F.col("id_1").alias("cell_id_1"), F.col("id_2").alias("cell_id_2"))
        out = p if out is None else out.unionByName(p)
    return out


CAPACITY = 2048
PCA_STEP = 1.0


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return density.groups_of_anchors(table(spark, d, "cell_expression"), table(spark, d, "cluster_anchors"), 15, PCA_STEP)


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each group of similar cells with its size, stability and most typical cells."""
    c = density.cluster(table(spark, d, "cell_expression"), "cell_id", "x_pca", 15, 2.0)
    return c.withColumn("stability", F.round("stability", 3))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five cells most similar to every 20th cell in x_pca, by greedy search among all cells."""
    cells = table(spark, d, "cell_expression")
    queries = cells.where("cell_id % 20 = 0").select(F.col("cell_id").alias("id"))
    return neighbours.search(cells, queries, "cell_id", "x_pca", 15, graph_k=10, trees=4, leaf=640, rounds=2).select(F.col("src").alias("cell_id"), F.col("dst").alias("near_id"), "rank")


def _tokens() -> Column:
    """Tokens of a byte-level tokenizer without special tokens."""
    return F.coalesce(F.octet_length("text"), F.lit(0))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", _tokens().alias("n"))
    return packing.pack(docs, "doc_id", "n", CAPACITY)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("n_pieces > 1").select(F.col("id").alias("doc_id")).distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Number of documents, fill and share of capacity used of each container."""
    return packing.containers(_packed(spark, d), CAPACITY)


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """What packing must keep: each document once, in full, in containers that aren't overfull."""
    p = _packed(spark, d)
    j = p.join(p.groupBy("bin").agg(F.sum("size").alias("fill")), "bin")
    return j.groupBy(F.col("id").alias("doc_id")).agg(F.sum("size").alias("size"), F.count("*").cast("int").alias("n_pieces"), (F.max("fill") <= CAPACITY).alias("fits"))


def _mixed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", _tokens().alias("n"))
    return mixing.mix(docs, table(spark, d, "mix_targets"), "doc_id", "source", "n")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)["report"].where("short").select("source")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached share of each source."""
    return _mixed(spark, d)["report"]


def p7_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The mixture itself: slots in order, with the documents of each."""
    return _mixed(spark, d)["drawn"]


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """What mixing must keep: no document is used more often than its source allows, no source gives more than it may."""
    m = _mixed(spark, d)
    uses = m["drawn"].groupBy("source", "id").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("most"))
    r = m["report"].join(uses, "source", "left")
    return r.select("source", "source_size", "short", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("in_repeats"), (F.col("drawn_size") <= F.col("max_repeats") * F.col("source_size")).alias("in_size"))


MOST_NAMES = 200_000  # words of item names that may be sent to all tasks


def _passages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    items = table(spark, d, "review_items").where("item_name is not null").select("item_name").distinct().limit(MOST_NAMES + 1).collect()
    if len(items) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} items; give their names as a table to join")
    names = languages.name_words(r["item_name"] for r in items)
    return languages.passages(docs, languages.fit(docs, names=names), names)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.label_errors(_passages(spark, d)).select(F.col("id").alias("doc_id"), "lang")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of every document with its language and confidence."""
    return _passages(spark, d).select(F.col("id").alias("doc_id"), "passage", "lang", "n_words", "confidence")


QUERIES = {f.__name__: f for f in (p3_found, p3_clusters, p5_found, p5_nearest, p6_found, p6_containers, p6_documents, p7_found, p7_report, p7_drawn, p7_limits, p8_found, p8_passages)}
_NEAR = """select '{space}' space, least(s, o) cell_id_1, greatest(s, o) cell_id_2 from (select s, o, row_number() over (partition by s order by d, o) k from (
    select a.cell_id s, b.cell_id o, array_distance(a.x, b.x) d from {space}_v a join {space}_v b on a.cell_id <> b.cell_id and a.x[1] between b.x[1] - {r} and b.x[1] + {r} and array_distance(a.x, b.x) <= {r})) where k <= 5"""
_VALID = "{space}_v as materialized (select cell_id, any_value({space})::double[{n}] x from cell_expression where cell_id is not null and len({space}) = {n} and len(list_filter({space}, lambda v: v is null or not isfinite(v))) = 0 group by cell_id)"
SQL = {
    "p3_found": f"""with recursive {_VALID.format(space="x_pca", n=15)},
        r as (select v.cell_id, a.anchor_id from cluster_anchors a join x_pca_v v on array_distance(v.x, a.x_pca::double[15]) <= 1.0 where len(a.x_pca) = 15
              union select w.cell_id, r.anchor_id from r join x_pca_v u on u.cell_id = r.cell_id join x_pca_v w on w.x[1] between u.x[1] - 1.0 and u.x[1] + 1.0 and array_distance(u.x, w.x) <= 1.0)
        select cell_id, anchor_id from r""",
    "p5_found": f"""with {", ".join(_VALID.format(space=s, n=n) for s, n, _ in SPACES)} {" union ".join(_NEAR.format(space=s, r=r) for s, _, r in SPACES)}""",
    "p6_found": "select doc_id from documents where coalesce(strlen(text), 0) > 2048",
    "p6_documents": "select doc_id, max(coalesce(strlen(text), 0))::bigint size, greatest(1, ceil(max(coalesce(strlen(text), 0)) / 2048))::int n_pieces, true fits from documents where doc_id is not null group by doc_id",
    "p7_limits": r"""
        with d as (select regexp_replace(lower(source), '[\s_-]+', '', 'g') k, sum(coalesce(strlen(text), 0)) size from documents where doc_id is not null group by 1),
        j as (select t.source, target_share, max_repeats, coalesce(d.size, 0)::bigint size from (select *, regexp_replace(lower(source), '[\s_-]+', '', 'g') k from mix_targets) t left join d using (k))
        select source, size source_size, target_share * (select sum(size) from j) > max_repeats * size short, true in_repeats, true in_size from j""",
    "p7_found": r"""
        with d as (select regexp_replace(lower(source), '[\s_-]+', '', 'g') k, sum(coalesce(strlen(text), 0)) size from documents group by 1),
        t as (select *, regexp_replace(lower(source), '[\s_-]+', '', 'g') k from mix_targets),
        j as (select t.source, target_share, max_repeats, coalesce(d.size, 0) size from t left join d using (k))
        select source from j where target_share * (select sum(size) from j) > max_repeats * size""",
}
