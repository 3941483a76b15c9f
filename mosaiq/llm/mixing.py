"""Records of several sources drawn to target shares of the total size.

Each source's documents are shuffled by hash and cut into blocks of equal size; a low-discrepancy sequence (multiples
of the golden ratio) mapped through the cumulative weights says which source comes next, and the rank of a slot
among its source's slots says which block is taken. Sources that run out are repeated, up to their cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mosaiq.session import Scratch

GOLDEN = 0.6180339887498949
CHUNK_ROWS = 20_000  # documents or slots of which a running sum or rank is formed in one go
MOST_SOURCES = 10_000


def source_key(c: Column) -> Column:
    """Sources are the same if they agree without regard to case, blanks, hyphens and underscores."""
    return F.lower(F.regexp_replace(c, r"[\s\-_]+", ""))


def chunked_sum(df: DataFrame, key: str, chunk: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over earlier rows of the key, in order of (chunk, order).

    Chunks are small and many, so that a hot key is spread over tasks; one row per key and chunk carries on.
    """
    sums = df.groupBy(key, chunk).agg(F.sum(value).alias("_s"))
    carry = sums.withColumn("_c", F.coalesce(F.sum("_s").over(W.partitionBy(key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    w = W.partitionBy(key, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumn("_l", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return d.join(carry, [key, chunk]).withColumn(out, F.col("_l") + F.col("_c")).drop("_l", "_c")


def mix(docs: DataFrame, targets: DataFrame, id_col: str, source: str, size: str, block: int = 8192, seed: int = 5, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """Draw documents so that each listed source meets its share of the total size, T, of all listed documents.

    Targets: source, target_share, max_repeats. Returns ``drawn`` (slot, source, pass, id, size), in which slots are
    in the order of the mixture, and ``report`` (source, target_share, max_repeats, source_size, wanted,
    drawn_size, drawn_share, short). A source that even max_repeats times its size can't fill is short; it
    gives all it may and the mixture is smaller by what lacks. Documents of null or unlisted sources, or with a
    null id, are not drawn. Sizes that are null or negative count as 0. Of targets that name the same source the first
    by name counts; negative or null shares and repeats count as 0. ``drawn`` has one row per use of a document.
    """
    s = scratch or Scratch(docs.sparkSession, "mix")
    t = targets.where("source is not null").withColumn("key", source_key(F.col("source"))).groupBy("key").agg(F.min(F.struct("source", "target_share", "max_repeats")).alias("t")).select("key", "t.*")
    t = t.withColumn("target_share", F.greatest(F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0))).withColumn("max_repeats", F.greatest(F.coalesce(F.col("max_repeats").cast("long"), F.lit(0)), F.lit(0)))
    d = docs.select(F.col(f"`{id_col}`").alias("id"), source_key(F.col(f"`{source}`")).alias("key"), F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    d = s.put(d.where("id is not null").join(t.select("key"), "key"), "listed")
    stat = t.join(d.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "key", "left").na.fill(0, ["source_size", "n"])
    rows = stat.orderBy("key").limit(MOST_SOURCES + 1).collect()  # one row per listed source
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources are listed")
    total = sum(r["source_size"] for r in rows)
    spark = docs.sparkSession

    # weights: what each source can give of what is wanted
    gives = {r["key"]: min(r["target_share"] * total, r["max_repeats"] * r["source_size"]) for r in rows}
    all_given = sum(gives.values())
    n_slots = round(all_given / block)
    drawn = None
    if n_slots:
        plan, low = [], 0.0
        for r in rows:
            high = low + gives[r["key"]] / all_given
            if gives[r["key"]] > 0:
                plan.append((r["key"], low, high, max(1, -(-r["source_size"] // block)), r["max_repeats"]))
            low = high
        plan[-1] = (plan[-1][0], plan[-1][1], 2.0, *plan[-1][3:])
        # [0, 1) in equal strips: each strip with the few sources that it touches, so that a slot meets its source by equality
        strips = 4 * len(plan)
        p = spark.createDataFrame(plan, "key string, low double, high double, n_blocks long, max_repeats long")
        first, last = F.floor(F.col("low") * strips), F.floor(F.least(F.col("high"), F.lit(1.0)) * strips)
        p = F.broadcast(p.withColumn("strip", F.explode(F.sequence(first, last))))  # at most 6 rows a source
        u = F.pmod(F.col("id") * F.lit(GOLDEN) + F.lit((seed % 97) / 97.0), F.lit(1.0))
        slots = spark.range(n_slots).withColumn("u", u).withColumn("strip", F.floor(F.col("u") * strips))
        slots = slots.join(p, "strip").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        slots = slots.select("key", F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK_ROWS).alias("chunk"), "n_blocks", "max_repeats")
        slots = chunked_sum(slots, "key", "chunk", ["slot"], F.lit(1), "rank")
        slots = slots.select("key", "slot", F.floor(F.col("rank") / F.col("n_blocks")).alias("pass"), (F.col("rank") % F.col("n_blocks")).alias("block"), "max_repeats")
        # blocks: documents in hash order, cut by their running size
        chunks = max(1, sum(r["n"] for r in rows) // CHUNK_ROWS)
        h = d.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("chunk", F.pmod("h", F.lit(chunks)))
        h = chunked_sum(h, "key", "chunk", ["h", "id"], F.col("size"), "at")
        h = h.withColumn("block", F.floor(F.col("at") / block))
        last = {k: n for k, _, _, n, _ in plan}
        h = h.join(F.broadcast(spark.createDataFrame([(k, n - 1) for k, n in last.items()], "key string, last long")), "key")
        h = h.withColumn("block", F.least("block", "last"))  # documents of size 0 behind the last full block
        drawn = slots.where(F.col("pass") < F.col("max_repeats")).join(h.select("key", "block", "id", "size"), ["key", "block"]).join(t.select("key", "source"), "key").select("slot", "source", "pass", "id", "size")
        drawn = s.put(drawn, "drawn")
    else:
        drawn = spark.createDataFrame([], "slot long, source string, pass long, id long, size long")
    got = drawn.groupBy("source").agg(F.sum("size").alias("drawn_size"))
    all_got = got.agg(F.sum("drawn_size")).first()[0] or 0
    r = stat.join(got, "source", "left").na.fill(0, ["drawn_size"])
    wanted = F.col("target_share") * F.lit(float(total))
    report = r.select("source", "target_share", "max_repeats", "source_size", wanted.alias("wanted"), "drawn_size", (F.col("drawn_size") / F.nullif(F.lit(float(all_got)), F.lit(0.0))).alias("drawn_share"), (wanted > F.col("max_repeats") * F.col("source_size")).alias("short"))
    return {"drawn": drawn, "report": report}
