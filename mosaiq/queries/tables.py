"""Queries of problems 1, 2 and 4: small files, drifting schemas, points near points and in regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.operators import compact, drift, spatial
from mosaiq.queries import scores
from mosaiq.session import Scratch, table

NEAR_UM = 4.6


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files = compact.compact_score_files(spark, table(spark, d, "score_files"))
    return compact.same_record_pairs(Scratch(spark, "records").put(compact.score_records(files), "parsed"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Each readable file with its record, and whether it is the file that is kept for the record."""
    files = compact.compact_score_files(spark, table(spark, d, "score_files"))
    r = compact.record_classes(Scratch(spark, "records").put(compact.score_records(files), "parsed"))
    return r.withColumn("kept", F.col("file_id") == F.col("record_id"))


def p1_compacted(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all tiny files as they are after compaction."""
    return compact.compact_score_files(spark, table(spark, d, "score_files")).select("file_id", "file_path", "file_text", "modified_at")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """The file that is kept for each record, in full, as a compacted table."""
    return compact.kept_files(spark, table(spark, d, "score_files"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_drift(table(spark, d, "meta_records"))["changes"].select("file_id", "field_name", "drift")


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """All readable records as one table: a row per record, a typed column per attribute, and what fits none."""
    return drift.unified(table(spark, d, "meta_records")).withColumn("other", F.to_json("other"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return spatial.positions(table(spark, d, "cells"), table(spark, d, "sections"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    p = _positions(spark, d)
    near = spatial.near_pairs(p, NEAR_UM).select(F.lit("near").alias("kind"), F.col("id_1").alias("key_1"), F.col("id_2").alias("key_2"))
    inside = spatial.points_in_regions(p, table(spark, d, "roi_regions"))
    return near.unionByName(inside.select(F.lit("inside").alias("kind"), F.col("cell_id").alias("key_1"), F.col("region_id").alias("key_2")))


def p4_region_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cells per region."""
    i = spatial.points_in_regions(_positions(spark, d), table(spark, d, "roi_regions"))
    return i.groupBy("region_id").agg(F.count("*").alias("n_cells"))


# positions of cells in micrometres, shared by the SQL of problem 4
_POSITIONS = """
latest as (select cell_id, arg_max(struct_pack(s := section, x := x, y := y), (exported_at, x, y, section)) r from cells group by cell_id),
pos as (select r.s section, cell_id, r.x * case when lower(trim(u.xy_unit)) = 'mm' then 1000.0 else 1.0 end x,
        r.y * case when lower(trim(u.xy_unit)) = 'mm' then 1000.0 else 1.0 end y
        from latest left join sections u on u.section = r.s
        where r.s is not null and r.x is not null and r.y is not null and not isnan(r.x) and not isnan(r.y) and not (r.x = 0 and r.y = 0)),
"""

_NEAR = """
g as (select *, floor(x / 4.6)::bigint gx, floor(y / 4.6)::bigint gy from pos),
o as (select unnest([-1, 0, 1]) i), oo as (select a.i, b.i j from o a, o b),
near as (select 'near' kind, a.cell_id key_1, b.cell_id key_2 from g a, oo, g b
         where a.section = b.section and b.gx = a.gx + oo.i and b.gy = a.gy + oo.j and a.cell_id < b.cell_id
         and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 4.6 * 4.6),
"""

_INSIDE = """
ring as (select region_id, section, xs, ys, case when xs[1] = xs[-1] and ys[1] = ys[-1] then len(xs) - 1 else len(xs) end n from roi_regions),
e as (select region_id, section, i, xs[i] x1, ys[i] y1, xs[i % n + 1] x2, ys[i % n + 1] y2 from (select *, unnest(range(1, n + 1)) i from ring)),
hit as (select p.cell_id, e.region_id,
        ((y1 <= p.y) <> (y2 <= p.y)) and (case when y2 > y1 then (x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) > 0 else (x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) < 0 end) crossing,
        ((x2 - x1) * (p.y - y1) - (y2 - y1) * (p.x - x1) = 0) and p.x between least(x1, x2) and greatest(x1, x2) onit
        from pos p join e on e.section = p.section and p.y between least(y1, y2) and greatest(y1, y2)),
inside as (select cell_id key_1, region_id key_2 from hit group by all having sum(crossing::int) % 2 = 1 or bool_or(onit))
"""

_RECORDS = f"""{scores._PARSED}, {scores._SCORE},
rec as (select distinct pm.file_id, concat_ws('|', run, "method", feature_type, coalesce(data_type, '-'), coalesce(distance, '-'), coalesce(env_k::varchar, '-'), weighted, coalesce(clustering_k::varchar, '-'), coalesce(annotation_level, '-'),
          coalesce(printf('%.3f', resolution), case when resolution_idx between 0 and 49 then printf('%.3f', pow(10, -1 + 3.5 * resolution_idx / 49)) end, 'idx' || coalesce(resolution_idx::varchar, '')),
          case when "method" in ('leiden', 'phenograph') and (data_type is null or distance is null) then algorithm_string else '' end, section) k, raw, normalized
        from pm join score on score.file_id = pm.file_id where run is not null)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_compacted, p1_kept, p2_found, p2_unified, p4_found, p4_region_counts)}

SQL = {
    "p1_found": f"""with {_RECORDS} select distinct least(a.file_id, b.file_id) file_id_1, greatest(a.file_id, b.file_id) file_id_2
        from rec a join rec b on a.k = b.k and a.file_id <> b.file_id where abs(a.raw - b.raw) < 0.0001 and coalesce(abs(a.normalized - b.normalized) < 0.0001, true)""",
    "p1_compacted": "select file_id, file_path, file_text, modified_at from score_files",
    "p4_found": f"with {_POSITIONS} {_NEAR} {_INSIDE} select kind, key_1, key_2 from near union all select 'inside', key_1, key_2 from inside",
    "p4_region_counts": f"with {_POSITIONS} {_INSIDE} select key_2 region_id, count(*) n_cells from inside group by key_2",
}
