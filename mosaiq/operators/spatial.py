"""Points near other points, and points in polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILLIMETRES = ("mm",)


def positions(cells: DataFrame, sections: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(section, cell_id, x, y, *keep) in micrometres, one row per cell: its row with the latest exported_at.

    Rows of a cell with equal exported_at are taken by the largest (x, y, section), a null exported_at counts as
    the earliest. Dropped as without position: null cell_id or section, x or y null or NaN, both exactly 0. Units
    come from ``sections.xy_unit`` (mm in any case, anything else is micrometres); sections that are not listed
    count as micrometres. The latest row decides even if it has no position.
    """
    latest = cells.where("cell_id is not null").groupBy("cell_id").agg(F.max(F.struct("exported_at", "x", "y", "section", *keep)).alias("r"))
    p = latest.select("cell_id", "r.section", "r.x", "r.y", *[f"r.{c}" for c in keep]).where("section is not null and x is not null and y is not null and not isnan(x) and not isnan(y) and not (x = 0 and y = 0)")
    if sections is not None:
        unit = sections.where("section is not null").groupBy("section").agg(F.max(F.lower(F.trim("xy_unit")).isin(*MILLIMETRES)).alias("mm"))
        p = p.join(unit, "section", "left")
        f = F.when(F.col("mm"), F.lit(1000.0)).otherwise(F.lit(1.0))
        p = p.withColumn("x", F.col("x") * f).withColumn("y", F.col("y") * f)
    return p.select("section", "cell_id", "x", "y", *keep)


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """Pairs (section, id_1, id_2, d2) of points of one section at most ``radius`` apart, smaller id first.

    Input: section, cell_id, x, y without nulls, ids unique. A grid join: cells of side ``radius``; a point meets
    its own grid cell and half of the eight around it, so each pair comes up once and no distinct is needed.
    A crowded grid cell only costs its own pairs, and adaptive execution splits its partition.
    """
    p = points.withColumn("gx", F.floor(F.col("x") / radius)).withColumn("gy", F.floor(F.col("y") / radius))
    half = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    a = p.select("section", F.col("cell_id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), "gx", "gy", F.explode(half).alias("o"))
    a = a.select("section", "a", "xa", "ya", (F.col("gx") + F.col("o.i")).alias("gx"), (F.col("gy") + F.col("o.j")).alias("gy"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    b = p.select("section", F.col("cell_id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), "gx", "gy")
    d2 = (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb"))
    j = a.join(b, ["section", "gx", "gy"]).where((~F.col("own") | (F.col("a") < F.col("b"))) & (d2 <= radius * radius))
    return j.select("section", F.least("a", "b").alias("id_1"), F.greatest("a", "b").alias("id_2"), d2.alias("d2"))


def polygon_edges(regions: DataFrame) -> DataFrame:
    """(section, region_id, x1, y1, x2, y2, xmin, xmax): edges of closed polygons.

    A first vertex repeated at the end is dropped, then the ring is closed; the direction doesn't matter. Regions
    with a null section or id, arrays of different length, a null or NaN vertex, or fewer than three vertices have
    no edges and contain nothing. A region listed twice counts once.
    """
    r = regions.select("region_id", "section", "xs", "ys").where("region_id is not null and section is not null and size(xs) = size(ys)").dropDuplicates(["region_id"])
    bad = lambda a: F.exists(a, lambda v: v.isNull() | F.isnan(v))
    r = r.where(~bad(F.col("xs")) & ~bad(F.col("ys")))
    shut = (F.element_at("xs", 1) == F.element_at("xs", -1)) & (F.element_at("ys", 1) == F.element_at("ys", -1)) & (F.size("xs") > 1)
    r = r.where("size(xs) > 0").withColumn("n", F.size("xs") - shut.cast("int")).where("n >= 3")
    ring = lambda c: F.concat(F.slice(c, 1, F.col("n")), F.array(F.element_at(c, 1)))
    r = r.select("section", "region_id", F.array_min("xs").alias("xmin"), F.array_max("xs").alias("xmax"), ring(F.col("xs")).alias("xs"), ring(F.col("ys")).alias("ys"), "n")
    e = r.select("section", "region_id", "xmin", "xmax", "xs", "ys", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    g = lambda c, k: F.get(F.col(c), F.col("i") + k)
    return e.select("section", "region_id", "xmin", "xmax", g("xs", 0).alias("x1"), g("ys", 0).alias("y1"), g("xs", 1).alias("x2"), g("ys", 1).alias("y2"))


def _strip(y: Column, height: float) -> Column:
    return F.floor(y / height)


def points_in_regions(points: DataFrame, regions: DataFrame, strip: float = 64.0) -> DataFrame:
    """(section, cell_id, region_id): regions that contain a point, by crossing parity.

    Edges are binned into latitude strips of height ``strip``, points join the edges of their strip and section,
    and the crossings of a ray to the right are counted per point and region; odd is inside. Half-open edges
    (one end at or below, the other above) count a vertex once. A point on an edge or vertex is inside. Edges of
    regions whose x range lacks the point are left out at the join, since they can't make it inside.
    """
    e = polygon_edges(regions)
    e = e.withColumn("strip", F.explode(F.sequence(_strip(F.least("y1", "y2"), strip), _strip(F.greatest("y1", "y2"), strip))))
    p = points.select("section", "cell_id", "x", "y").withColumn("strip", _strip(F.col("y"), strip))
    j = p.join(e, ["section", "strip"]).where("x between xmin and xmax and y between least(y1, y2) and greatest(y1, y2)")
    cross = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1"))
    on = (cross == 0) & F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2"))
    spans = (F.col("y1") <= F.col("y")) != (F.col("y2") <= F.col("y"))
    right = F.when(F.col("y2") > F.col("y1"), cross > 0).otherwise(cross < 0)  # the edge lies to the right of the point
    g = j.groupBy("section", "cell_id", "region_id").agg(F.sum((spans & right).cast("int")).alias("n"), F.max(on).alias("on"))
    return g.where("n % 2 = 1 or on").select("section", "cell_id", "region_id")
