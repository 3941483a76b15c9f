"""Queries over feature vectors and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import clustering, communities, features, neighbors, similarity, spatial
from mosaiq.session import Scratch, table

N_FEATURES = 8


def _feature_knn(metric: str):
    def q(spark: SparkSession, d: str) -> DataFrame:
        v = table(spark, d, "embeddings")
        return similarity.query_knn(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 64, 15, metric).select("src", "dst", "k")

    q.__name__ = f"feature_knn_{metric}"
    q.__doc__ = f"The 15 nearest vectors by {metric} of every 20th vector, among all."
    return q


def feature_graph(spark: SparkSession, d: str) -> DataFrame:
    """Approximate neighbours of every embedding by correlation."""
    return similarity.feature_graph(table(spark, d, "embeddings"), "vec_id", "embedding", 64, 15, "correlation").select("src", "dst", "k")


def _spatial_graph(spark: SparkSession, d: str) -> DataFrame:
    s = Scratch(spark, "graph")
    p = spatial.positions(table(spark, d, "cells"), table(spark, d, "sections"))
    return s.put(neighbors.spatial_knn(p, 10, scratch=s).select("src", "dst"), "edges")


def jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five cells with the most similar spatial neighbourhoods, per cell."""
    return similarity.jaccard_topk(_spatial_graph(spark, d), 5).withColumn("similarity", F.round("similarity", 6))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Same-order adjacency of the labelings: how often a label of one configuration meets another label in a cell's rows."""
    e = table(spark, d, "cluster_labels").where("label >= 0").select(F.col("cell_id").alias("src"), F.col("label").cast("long").alias("dst"))
    return similarity.adjacency(e)


def modularity_of_classes(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the cell classes in the spatial neighbour graph."""
    lab = spatial.positions(table(spark, d, "cells"), table(spark, d, "sections"), ("class",)).select(F.col("cell_id").alias("id"), F.col("class").alias("label"))
    return communities.modularity(_spatial_graph(spark, d), lab.where("label is not null")).withColumn("modularity", F.round("modularity", 6))


def leiden_clusters(spark: SparkSession, d: str) -> DataFrame:
    return communities.leiden(_spatial_graph(spark, d), 1.0)


def phenograph_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the Jaccard graph of spatial neighbourhoods."""
    g = similarity.jaccard_topk(_spatial_graph(spark, d), 5).withColumnRenamed("similarity", "weight")
    return communities.leiden(g.select("src", "dst", "weight"), 1.0)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return features.valid(table(spark, d, "cell_expression"), "features", N_FEATURES)


def log1p_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.extract(_features(spark, d), "log1p").select("cell_id", F.posexplode("features").alias("i", "v"))
    return f.select("cell_id", "i", F.round("v", 6).alias("v"))


def standardised_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.standardised(_features(spark, d), "features", N_FEATURES).select("cell_id", F.posexplode("features").alias("i", "v"))
    return f.select("cell_id", "i", F.round("v", 4).alias("v"))


def pca_features(spark: SparkSession, d: str) -> DataFrame:
    f = features.extract(_features(spark, d), "log1p")
    return features.pca(f, "features", 3).withColumn("pca", F.transform("pca", lambda x: F.round(x, 6)))


def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.kmeans(features.extract(_features(spark, d), "log1p"), "features", 10)


def lda_topics(spark: SparkSession, d: str) -> DataFrame:
    return clustering.lda(_features(spark, d), "features", 5).select("cell_id", "label")


_METRIC = {
    "euclidean": "list_distance(a.e, b.e)",
    "cosine": "1 - list_cosine_similarity(a.e, b.e)",
    "correlation": "1 - list_cosine_similarity(a.c, b.c)",
}
_KNN_SQL = """with v as (select vec_id, embedding::double[] e, list_transform(embedding::double[], lambda x: x - list_avg(embedding::double[])) c from embeddings where embedding is not null),
 p as (select a.vec_id src, b.vec_id dst, {metric} dist from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
 select src, dst, k from (select *, row_number() over (partition by src order by dist, dst) k from p) where k <= 15"""

_E = """
latest as (select cell_id, arg_max(struct_pack(s := section, x := x, y := y, c := class), (exported_at, x, y, section, class)) r from cells group by cell_id),
pos as (select r.s section, cell_id, r.c "type", r.x * case when lower(trim(u.xy_unit)) = 'mm' then 1000.0 else 1.0 end x,
        r.y * case when lower(trim(u.xy_unit)) = 'mm' then 1000.0 else 1.0 end y
        from latest left join sections u on u.section = r.s
        where r.s is not null and r.x is not null and r.y is not null and not isnan(r.x) and not isnan(r.y) and not (r.x = 0 and r.y = 0)),
pairs as (select a.section, a.cell_id src, b.cell_id dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) d2 from pos a join pos b on a.section = b.section and a.cell_id <> b.cell_id),
e as (select src, dst from (select *, row_number() over (partition by section, src order by d2, dst) k from pairs) where k <= 10)
"""
_F = "f as (select cell_id, min(features)::double[] v from cell_expression where len(features) = 8 and cell_id is not null and len(list_filter(features, lambda x: x is null or isnan(x))) = 0 group by cell_id), l as (select cell_id, unnest(range(8))::int i, v from f)"

QUERIES = {f.__name__: f for f in (*[_feature_knn(m) for m in similarity.METRICS], feature_graph, jaccard_topk, adjacency, modularity_of_classes, leiden_clusters, phenograph_clusters, log1p_features, standardised_features, pca_features, kmeans_clusters, lda_topics)}

SQL = {
    **{f"feature_knn_{m}": _KNN_SQL.format(metric=e) for m, e in _METRIC.items()},
    "jaccard_topk": f"""with {_E}, n as (select src, count(*) n from e group by src), hop as (select distinct a.src, b.dst j from e a join e b on a.dst = b.src where a.src <> b.dst),
        common as (select a.src, b.src j, count(*) c from e a join e b on a.dst = b.dst where a.src <> b.src group by all),
        s as (select src, j, c::double / (x.n + y.n - c) similarity from hop join common using (src, j) join n x using (src) join n y on y.src = j)
        select src, j dst, round(similarity, 6) similarity, rank from (select *, row_number() over (partition by src order by similarity desc, j) rank from s) where rank <= 5""",
    "adjacency": "select cell_id src, label::bigint dst, count(*) weight from cluster_labels where label >= 0 group by all",
    "modularity_of_classes": f"""with {_E}, b as (select src u, dst v from e union all select dst, src from e),
        j as (select p.type cu, q.type cv from b join pos p on p.cell_id = u join pos q on q.cell_id = v where p.type is not null and q.type is not null),
        k as (select cu, count(*)::double k, count_if(cu = cv)::double i from j group by cu)
        select round(sum(i) / sum(k) - sum(k * k) / (sum(k) * sum(k)), 6) modularity from k""",
    "log1p_features": f"with {_F} select cell_id, i, round(ln(1 + v[i + 1]), 6) v from l",
    "standardised_features": f"with {_F} select cell_id, i, round(case when s > 0 then (v[i + 1] - m) / s else 0 end, 4) v from l join (select i, avg(v[i + 1]) m, stddev_pop(v[i + 1]) s from l group by i) using (i)",
}
