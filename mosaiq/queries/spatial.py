"""Spatial queries over the cells table: neighbours, neighbourhoods, percolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import neighborhood, neighbors, percolation, spatial
from mosaiq.session import Scratch, table

K = 10
SCORE_K = 100
THRESHOLD = 0.2


def _typed(spark: SparkSession, d: str) -> DataFrame:
    p = spatial.positions(table(spark, d, "cells"), table(spark, d, "sections"), ("class",))
    return p.withColumnRenamed("class", "type")


def _knn(spark: SparkSession, d: str, with_self: bool = False) -> tuple[DataFrame, DataFrame, Scratch]:
    s = Scratch(spark, "spatial")
    p = s.put(_typed(spark, d), "typed")
    return p, neighbors.spatial_knn(p, K, with_self, s), s


def _edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Scratch]:
    s = Scratch(spark, "spatial")
    p = s.put(_typed(spark, d), "typed")
    return p, s.put(percolation.activation_edges(p, K, scratch=s), "edges"), s


def _zoned(e: DataFrame, s: Scratch) -> DataFrame:
    """(section, variant, cell_id, zone) of edges with section and type."""
    named = e.select("section", F.xxhash64("section").alias("sec"), F.lit(0).cast("byte").alias("variant"), F.xxhash64("type").alias("t"), "src", "dst")
    return percolation.zone_labels(s, named).join(named.select("section", "sec").distinct(), "sec")


def spatial_knn_edges(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d)[1].select("section", "src", "dst", "k")


def knn_with_self(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d, True)[1].select("section", "src", "dst", "k")


def localfreq_counts(spark: SparkSession, d: str) -> DataFrame:
    p, knn, _ = _knn(spark, d, True)
    return neighborhood.type_counts(knn, p)


def _weighted(spark: SparkSession, d: str, scale_index: int) -> DataFrame:
    p, knn, _ = _knn(spark, d, True)
    return neighborhood.type_weights(knn, p, K, scale_index).withColumn("w", F.round("w", 6))


def localfreq_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, 4)


def env_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _weighted(spark, d, 5)


def type_fraction(spark: SparkSession, d: str) -> DataFrame:
    return neighborhood.type_fractions(_typed(spark, d)).withColumn("fraction", F.round("fraction", 6))


def permuted_labels(spark: SparkSession, d: str) -> DataFrame:
    return percolation.permuted_types(_typed(spark, d))


def activation_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)[1].withColumn("p", F.round("p", 6))


def component_entropy_at_p(spark: SparkSession, d: str) -> DataFrame:
    """Entropy of the components of edges up to one bond probability, per section."""
    p, e, s = _edges(spark, d)
    z = _zoned(e.where(F.col("p") <= THRESHOLD), s)
    size = z.groupBy("section", "zone").agg(F.count("*").alias("s")).groupBy("section").agg(F.sum(F.col("s") * F.log2("s")).alias("t"))
    n = p.groupBy("section").agg(F.count("*").alias("n"))
    return n.join(size, "section", "left").select("section", "n", F.round(F.log2("n") - F.coalesce("t", F.lit(0.0)) / F.col("n"), 6).alias("entropy"))


def entropy_curve(spark: SparkSession, d: str) -> DataFrame:
    return percolation.entropy_curve(_typed(spark, d), K).withColumn("entropy", F.round("entropy", 6))


def type_entropy_curves(spark: SparkSession, d: str) -> DataFrame:
    return percolation.type_entropy_curves(_typed(spark, d), K).withColumn("entropy", F.round("entropy", 6))


def _zone_table(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p, e, s = _edges(spark, d)
    return p, s.put(percolation.zone_table(p, _zoned(e, s)), "zones")


def zones_centroids(spark: SparkSession, d: str) -> DataFrame:
    z = _zone_table(spark, d)[1]
    return z.select("section", "type", "zone", "size", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def macro_edges(spark: SparkSession, d: str) -> DataFrame:
    p, z = _zone_table(spark, d)
    return percolation.macro_edges(z, neighborhood.type_fractions(p)).drop("variant").withColumn("p", F.round("p", 6))


def percolation_score(spark: SparkSession, d: str) -> DataFrame:
    """Raw and normalized score per section: local and macroscopic edges, against permuted types."""
    r = percolation.score_sections(_typed(spark, d), SCORE_K)
    return r.select("section", "n", F.round("raw", 6).alias("raw"), F.round("normalized", 6).alias("normalized"))


def stuck_users(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of inactivity of more than 12 hours per user."""
    from mosaiq.streaming import monitor

    return monitor.stuck_batch(table(spark, d, "events"), "user_id", "ts", 12 * 3600)


_POS = """
latest as (select cell_id, arg_max(struct_pack(s := section, x := x, y := y, c := class), (exported_at, x, y, section, class)) r from cells group by cell_id),
pos as (select r.s section, cell_id, r.c "type", r.x * case when lower(trim(u.xy_unit)) = 'mm' then 1000.0 else 1.0 end x,
        r.y * case when lower(trim(u.xy_unit)) = 'mm' then 1000.0 else 1.0 end y
        from latest left join sections u on u.section = r.s
        where r.s is not null and r.x is not null and r.y is not null and not isnan(r.x) and not isnan(r.y) and not (r.x = 0 and r.y = 0))
"""
_PAIRS = """
pairs as (select a.section, a.cell_id src, b.cell_id dst, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) d2
          from pos a join pos b on a.section = b.section {no_self}),
knn as (select * from (select *, row_number() over (partition by section, src order by d2, src <> dst, dst) k from pairs) where k <= 10)
"""
_KNN = _POS + "," + _PAIRS.format(no_self="and a.cell_id <> b.cell_id")
_KNN_SELF = _POS + "," + _PAIRS.format(no_self="")
_FRAC = """frac as (select section, "type", n, n::double / sum(n) over (partition by section) fraction
    from (select section, "type", count(*) n from pos where "type" is not null group by section, "type"))"""
_WEIGHT = """
, h as (select *, greatest(2.0 * coalesce(max(case when k = {at} then sqrt(d2) end) over (partition by section, src), max(sqrt(d2)) over (partition by section, src)), 1e-6) h from knn)
select h.section, src cell_id, p."type", round(sum(exp(-d2 / (h * h))), 6) w from h join pos p on p.section = h.section and p.cell_id = h.dst where p."type" is not null group by all
"""
_ACT = _KNN + "," + _FRAC + """,
same as (select k.section, a."type", k.src, k.dst, k.k, f.fraction from knn k join pos a on a.section = k.section and a.cell_id = k.src
         join pos b on b.section = k.section and b.cell_id = k.dst join frac f on f.section = a.section and f."type" = a."type" where a."type" = b."type"),
act as (select section, "type", src, dst, k, 1.0 - exp(-(k - 1 + (row_number() over (partition by section, k order by md5('42|' || src || '|' || dst), src, dst) - 1)::double
        / count(*) over (partition by section, k)) * fraction) p from same)
"""
_REACH = """,
und as (select section, src u, dst v from act {where} union select section, dst, src from act {where}),
reach as (select section, u, u v from und union select r.section, r.u, e.v from reach r join und e on e.section = r.section and e.u = r.v),
zoned as (select section, u cell_id, min(v) zone from reach group by all)
"""

# smallest label of each cell's component at each step of the sweep
_LABELS = """,
 und as materialized (select section, src u, dst v, (ceil(p * 100 - 1e-12) - 1)::int step from act where p > 0.01 union all select section, dst, src, (ceil(p * 100 - 1e-12) - 1)::int from act where p > 0.01),
 lab(section, t, u, l) using key (section, t, u) as (
   select distinct section, t, u, u from und, range(1, 100) s(t)
   union select e.section, x.t, e.v, min(x.l) from lab x join und e on e.section = x.section and e.u = x.u and e.step <= x.t
   join recurring.lab c on c.section = x.section and c.t = x.t and c.u = e.v where x.l < c.l group by all)
"""

QUERIES = {
    f.__name__: f
    for f in (spatial_knn_edges, knn_with_self, localfreq_counts, localfreq_weighted, env_weighted, type_fraction, permuted_labels, activation_edges, component_entropy_at_p, entropy_curve, type_entropy_curves, zones_centroids, macro_edges, percolation_score, stuck_users)
}

SQL = {
    "spatial_knn_edges": f"with {_KNN} select section, src, dst, k from knn",
    "knn_with_self": f"with {_KNN_SELF} select section, src, dst, k from knn",
    "localfreq_counts": f"""with {_KNN_SELF} select k.section, k.src cell_id, p."type", count(*) n from knn k join pos p on p.section = k.section and p.cell_id = k.dst where p."type" is not null group by all""",
    "localfreq_weighted": f"with {_KNN_SELF} {_WEIGHT.format(at=5)}",
    "env_weighted": f"with {_KNN_SELF} {_WEIGHT.format(at=6)}",
    "type_fraction": f"""with {_POS}, {_FRAC} select section, "type", n, round(fraction, 6) fraction from frac""",
    "permuted_labels": f"""with {_POS}, a as (select section, cell_id, row_number() over (partition by section order by cell_id) r from pos),
        b as (select section, "type", row_number() over (partition by section order by md5('42|' || cell_id), cell_id) r from pos)
        select a.section, a.cell_id, b."type" from a join b using (section, r)""",
    "activation_edges": f"""with {_ACT} select section, "type", src, dst, k, round(p, 6) p from act""",
    "component_entropy_at_p": f"""with recursive {_ACT} {_REACH.format(where="where p <= 0.2")},
        sz as (select section, sum(s * log2(s)) t from (select section, zone, count(*) s from zoned group by all) group by section),
        n as (select section, count(*) n from pos group by section)
        select n.section, n.n, round(log2(n.n) - coalesce(t, 0) / n.n, 6) entropy from n left join sz using (section)""",
    "entropy_curve": f"""with recursive {_ACT} {_LABELS},
        sz as (select section, t, sum(s * log2(s)) s from (select section, t, l, count(*) s from lab group by all) group by all),
        n as (select section, count(*) n from pos group by section)
        select n.section, t::int step, t / 100.0 pbond, round(log2(n) - coalesce(s, 0) / n, 6) entropy, n from n cross join range(1, 100) g(t) left join sz using (section, t)""",
    "type_entropy_curves": f"""with recursive {_ACT} {_LABELS},
        sz as (select section, "type", t, sum(s * log2(s)) s from (select lab.section, "type", t, l, count(*) s from lab join pos p on p.section = lab.section and p.cell_id = lab.u group by all) group by all),
        n as (select section, "type", count(*) n from pos where "type" is not null group by all),
        has as (select distinct section, "type" from act)
        select n.section, n."type", g.t::int step, round(log2(n) - coalesce(s, 0) / n, 6) + 0.0 entropy from has join n using (section, "type") cross join range(1, 100) g(t) left join sz on sz.section = n.section and sz."type" = n."type" and sz.t = g.t""",
    "zones_centroids": f"""with recursive {_ACT} {_REACH.format(where="")}
        select p.section, p."type", coalesce(z.zone, p.cell_id) zone, count(*) size, round(avg(x), 4) x, round(avg(y), 4) y
        from pos p left join zoned z on z.section = p.section and z.cell_id = p.cell_id where p."type" is not null group by all""",
    "macro_edges": f"""with recursive {_ACT} {_REACH.format(where="")},
        z as (select p.section, p."type", coalesce(z.zone, p.cell_id) zone, count(*) size, avg(x) x, avg(y) y
              from pos p left join zoned z on z.section = p.section and z.cell_id = p.cell_id where p."type" is not null group by all),
        many as (select section, "type" from z group by all having count(*) > 1),
        j as (select a.section, a."type" ta, b."type" tb, a.zone za, b.zone zb, sum(b.size) over (partition by a.section, a.zone
              order by (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.zone rows unbounded preceding) k
              from z a join many m on m.section = a.section and m."type" = a."type" join z b on b.section = a.section and b.zone <> a.zone),
        e as (select section, ta, least(za, zb) src, greatest(za, zb) dst, min(k) k from j where ta = tb group by all)
        select e.section, ta "type", src, dst, round(1.0 - exp(-greatest(k, 1) * fraction), 6) p from e join frac f on f.section = e.section and f."type" = ta where 1.0 - exp(-greatest(k, 1) * fraction) <= 0.99""",
    "stuck_users": """select user_id, ts last_seen, next_ts resumed from (select user_id, ts, lead(ts) over (partition by user_id order by ts, event_id) next_ts from events)
        where next_ts - ts > interval 12 hours""",
}
