"""Schemas that drift between the files of a writer: what changed, and one consistent table.

Steps, all on the aggregated level (writer, file, field):

1. payloads are read as variants and taken apart into fields, each value with its JSON type and comparable tokens;
2. each (writer, field) gets a profile: a bottom-k sketch of its tokens; each field name one over all writers;
3. a file's fields are compared with those of the writer's previous file: gone fields and new fields meet, each
   meeting is weighed by values, types and names, less the more often both names stand in one file, and a bipartite
   matching keeps the renames;
4. renames link stretches of a field into attributes, along which types are compared;
5. for one table of all writers, their schemas are matched one after the other in the same way, by field name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.operators.ordered import carry_last
from mosaiq.session import Scratch

SKETCH = 256  # tokens kept of a profile, those with the smallest hashes
WEIGHTS = {"values": 0.55, "names": 0.35, "types": 0.1}
PRIOR = 8.0  # a writer's own values weigh as much as those of all writers at so many tokens
LEAST_WEIGHT = 0.4  # a pair below is no rename
MOST_NAMES = 5_000  # field names of one table, as names become columns; more raise an error


def fields(records: DataFrame) -> DataFrame:
    """(writer, file_seq, file_id, record_id, key, value, kind): a row for each field of each readable payload.

    kind is string, number, boolean, array or object, null for a JSON null. Repeated records count once. Rows with
    null writer, file_seq or file_id are left out, as are payloads that are null, don't parse or aren't objects.
    """
    r = records.select("record_id", "writer", "file_seq", "file_id", "payload").where("payload is not null and writer is not null and file_seq is not null and file_id is not null").dropDuplicates(["record_id"])
    r = r.select("record_id", "writer", "file_seq", "file_id", F.try_parse_json("payload").alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    e = r.lateralJoin(r.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    t = F.schema_of_variant("value")
    kind = F.when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t == "VOID", None).otherwise("number")
    return e.select("writer", "file_seq", "file_id", "record_id", "key", "value", kind.alias("kind"))


def tokens(value: Column, kind: Column) -> Column:
    """Comparable tokens of a variant of the given kind as an array of strings.

    Arrays and objects give the scalars within them. Numbers, also as text and with p for the decimal point, are
    taken to three decimals, so that 3.162278, "3.162" and "3p162" are the same; other text is lower-cased.
    """
    three = lambda x: F.round(x, 3).cast("string")
    looks = r"^[+-]?\d+(p\d+)?$|^[+-]?\d*\.?\d+(e[+-]?\d+)?$"
    text = lambda x: F.when(x.rlike(looks), three(F.replace(x, F.lit("p"), F.lit(".")).try_cast("double"))).otherwise(x)
    leaves = F.transform(F.regexp_extract_all(F.to_json(value), F.lit(r'("(?:[^"\\]|\\.)*"\s*:)|("(?:[^"\\]|\\.)*"|[^\s\[\]{},:"]+)'), F.lit(2)), lambda x: F.lower(F.regexp_replace(x, '^"|"$', "")))
    nested = F.transform(F.filter(leaves, lambda x: ~x.isin("", "null")), text)
    one = lambda x: F.when(x.isNotNull() & (x != ""), F.array(x)).otherwise(F.array().cast("array<string>"))
    return (
        F.when(kind == "number", one(three(F.try_variant_get(value, "$", "double"))))
        .when(kind == "string", one(text(F.lower(F.try_variant_get(value, "$", "string")))))
        .when(kind.isNull(), F.array().cast("array<string>"))
        .otherwise(nested)
    )


def _sketches(toks: DataFrame, by: list[str]) -> DataFrame:
    """Bottom-k sketch of the distinct tokens per group."""
    h = toks.select(*by, F.col("h")).distinct()
    w = W.partitionBy(*by).orderBy("h")
    return h.withColumn("n", F.row_number().over(w)).where(F.col("n") <= SKETCH).groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that is in the other, from bottom-k sketches; null if one is empty.

    Hashes above the largest of a full sketch are left out on both sides, as the sketch doesn't know them.
    """
    top = lambda s: F.when(F.size(s) >= SKETCH, F.array_max(s)).otherwise(F.lit(2**63 - 1))
    cut = F.least(top(a), top(b))
    n = lambda s: F.size(F.filter(s, lambda h: h <= cut))
    return F.size(F.array_intersect(a, b)) / F.nullif(F.least(n(a), n(b)), F.lit(0))


def ochiai(a: Column, b: Column) -> Column:
    """Shared tokens against the geometric mean of both sets' sizes, from bottom-k sketches."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.sqrt(F.size(a).cast("double") * F.size(b)), F.lit(0.0))


def name_similarity(a: Column, b: Column) -> Column:
    """0..1: the better of edit distance without case and separators, and shared name parts (also abbreviated)."""
    flat = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    parts = lambda c: F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_")), "_"), lambda p: p != "")
    edit = F.lit(1.0) - F.levenshtein(flat(a), flat(b)) / F.greatest(F.length(flat(a)), F.length(flat(b)), F.lit(1))
    pa, pb = parts(a), parts(b)
    hit = lambda p, q: p.startswith(q) | q.startswith(p)
    hits = lambda x, y: F.size(F.filter(x, lambda p: F.exists(y, lambda q: hit(p, q))))
    return F.greatest(edit, (hits(pa, pb) + hits(pb, pa)) / F.greatest(F.size(pa) + F.size(pb), F.lit(1)))


def type_similarity(a: Column, b: Column) -> Column:
    """1 for the same JSON type, 0.5 for a number and text, which may hold one, 0 for others; 0.5 where a type isn't known."""
    scalar = a.isin("number", "string") & b.isin("number", "string")
    return F.when(a == b, 1.0).when(a.isNull() | b.isNull() | scalar, 0.5).otherwise(0.0)


def together(present: DataFrame) -> DataFrame:
    """(f, g, share): how often two field names stand in one file, against the files of the rarer; pairs that never do aren't listed.

    Counted over the distinct schemas of files, with how many files have each.
    """
    schemas = present.groupBy("writer", "file_seq", "file_id").agg(F.array_sort(F.collect_set("field")).alias("names")).groupBy("names").agg(F.count("*").alias("n"))
    one = schemas.select(F.explode("names").alias("f"), "n").groupBy("f").agg(F.sum("n").alias("n_f"))
    two = schemas.select(F.explode("names").alias("f"), "names", "n").select("f", F.explode("names").alias("g"), "n").where("f <> g").groupBy("f", "g").agg(F.sum("n").alias("n"))
    return two.join(one, "f").join(one.toDF("g", "n_g"), "g").select("f", "g", (F.col("n") / F.least("n_f", "n_g")).alias("share"))


def best_matching(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of the bipartite matching with the largest total weight (Hungarian method, potentials)."""
    flip = weight.shape[0] > weight.shape[1]
    cost = -(weight.T if flip else weight)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            used[j0] = True
            cur = cost[match[j0] - 1] - u[match[j0]] - v[1:]
            better = ~used[1:] & (cur < least[1:])
            least[1:][better], way[1:][better] = cur[better], j0
            j1 = 1 + int(np.argmin(np.where(used[1:], np.inf, least[1:])))
            d = least[j1]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


_RENAME = T.ArrayType(T.StructType([T.StructField("old", T.StringType()), T.StructField("new", T.StringType())]))


@F.pandas_udf(_RENAME)
def _renames(gone: pd.Series, new: pd.Series, weight: pd.Series) -> pd.Series:
    out = []
    for g, n, w in zip(gone, new, weight):
        gs, ns = sorted(set(g)), sorted(set(n))
        m = np.zeros((len(gs), len(ns)))
        for a, b, x in zip(g, n, w):
            m[gs.index(a), ns.index(b)] = x if x >= LEAST_WEIGHT else 0
        out.append([{"old": gs[i], "new": ns[j]} for i, j in best_matching(m) if m[i, j] > 0])
    return pd.Series(out)


def schema_drift(records: DataFrame, scratch: Scratch | None = None) -> dict[str, DataFrame]:
    """Changes from each file of a writer to the writer's next one, in order of file_seq.

    Returns ``changes`` (writer, file_seq, file_id, field_name, drift, new_name), ``attributes`` (writer, file_seq,
    file_id, field, attribute, kind: the attribute is the field name with which it began), both as DataFrames.
    A writer's first file has no changes. Files without any readable payload take no part. An empty table has none.
    """
    spark = records.sparkSession
    s = scratch or Scratch(spark, "drift")
    raw = s.put(fields(records).select("writer", "file_seq", "file_id", "key", "kind", F.transform(tokens(F.col("value"), F.col("kind")), lambda t: F.xxhash64(t)).alias("h")), "fields")
    by_kind = raw.groupBy("writer", "file_seq", "file_id", F.col("key").alias("field"), "kind").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind")))
    per_file = s.put(by_kind.groupBy("writer", "file_seq", "file_id", "field").agg(best["kind"].alias("kind")), "profile")

    files = per_file.select("writer", "file_seq", "file_id").distinct().withColumn("me", F.struct("file_seq", "file_id"))
    files = s.put(carry_last(s, files, ["writer"], ["file_seq", "file_id"], "me", "before").drop("me"), "files")
    present = per_file.where("field is not null")
    cur = present.join(files, ["writer", "file_seq", "file_id"]).select("writer", "file_seq", "file_id", "before", "field", F.lit(True).alias("now"))
    nxt = files.where("before is not null").select("writer", F.col("file_seq").alias("seq"), F.col("file_id").alias("id"), "before.file_seq", "before.file_id", "before")
    old = present.join(nxt, ["writer", "file_seq", "file_id"]).select("writer", F.col("seq").alias("file_seq"), F.col("id").alias("file_id"), "before", "field", F.lit(True).alias("then"))
    both = cur.join(old.drop("before"), ["writer", "file_seq", "file_id", "field"], "full")
    starts = s.put(both.where("now is null or then is null").join(files.select("writer", "file_seq", "file_id", F.col("before").alias("b")), ["writer", "file_seq", "file_id"]).select("writer", "file_seq", "file_id", "field", F.col("now").isNotNull().alias("new"), F.col("b").alias("before")), "starts")

    # profiles of the fields that came or went
    toks = raw.select("writer", F.col("key").alias("field"), F.explode("h").alias("h")).distinct()
    own, everywhere = _sketches(toks, ["writer", "field"]), _sketches(toks, ["field"])
    kinds = per_file.select("writer", "field", "kind", F.struct("file_seq", "file_id").alias("at"))
    g = starts.where("not new and before is not null").select("writer", "file_seq", "file_id", F.col("field").alias("old_f"), "before")
    g = g.join(kinds.toDF("writer", "old_f", "old_kind", "before"), ["writer", "old_f", "before"]).drop("before")
    n = starts.where("new and before is not null").select("writer", "file_seq", "file_id", F.col("field").alias("new_f"), F.struct("file_seq", "file_id").alias("at"))
    n = n.join(kinds.toDF("writer", "new_f", "new_kind", "at"), ["writer", "new_f", "at"]).drop("at")
    pairs = g.join(n, ["writer", "file_seq", "file_id"])
    for side in ("old", "new"):
        pairs = pairs.join(own.toDF("writer", f"{side}_f", f"{side}_own"), ["writer", f"{side}_f"], "left").join(everywhere.toDF(f"{side}_f", f"{side}_all"), f"{side}_f", "left")
    few = F.coalesce(F.least(F.size("old_own"), F.size("new_own")), F.lit(0))  # few own values say little: the names' other writers fill in
    n_own = F.greatest(few, F.lit(0))
    values = (n_own * F.coalesce(containment(F.col("old_own"), F.col("new_own")), F.lit(0.0)) + PRIOR * F.coalesce(ochiai(F.col("old_all"), F.col("new_all")), F.lit(0.0))) / (n_own + PRIOR)
    weight = WEIGHTS["values"] * values + WEIGHTS["names"] * name_similarity(F.col("old_f"), F.col("new_f")) + WEIGHTS["types"] * type_similarity(F.col("old_kind"), F.col("new_kind"))
    both_in = s.put(together(present), "together")
    pairs = pairs.join(both_in.toDF("old_f", "new_f", "share"), ["old_f", "new_f"], "left")
    weight = weight * (1.0 - F.coalesce("share", F.lit(0.0)))
    pairs = pairs.select("writer", "file_seq", "file_id", "old_f", "new_f", weight.alias("weight"))
    met = pairs.groupBy("writer", "file_seq", "file_id").agg(F.collect_list("old_f").alias("g"), F.collect_list("new_f").alias("n"), F.collect_list("weight").alias("w"))
    renamed = s.put(met.select("writer", "file_seq", "file_id", F.explode(_renames("g", "n", "w")).alias("r")).select("writer", "file_seq", "file_id", "r.old", "r.new"), "renamed")

    # stretches of a field, linked by renames into attributes
    begun = starts.where("new").select("writer", "file_seq", "file_id", "field", F.struct("file_seq", "file_id").alias("start"))
    marked = present.join(begun, ["writer", "file_seq", "file_id", "field"], "left")
    marked = s.put(carry_last(s, marked, ["writer", "field"], ["file_seq", "file_id"], "start", "since", inclusive=True).drop("start"), "stretches")
    node = lambda w, f, at: F.struct(w.alias("writer"), f.alias("field"), at.alias("since"))
    link = renamed.join(files, ["writer", "file_seq", "file_id"]).select("writer", "file_seq", "file_id", "before", "old", "new")
    parent = marked.select("writer", F.struct("file_seq", "file_id").alias("before"), F.col("field").alias("old"), F.col("since").alias("old_since"))
    link = link.join(parent, ["writer", "before", "old"]).select(node(F.col("writer"), F.col("new"), F.struct("file_seq", "file_id")).alias("child"), node(F.col("writer"), F.col("old"), F.col("old_since")).alias("root"))
    link = s.put(link, "links")
    while True:  # pointer doubling: as many rounds as the binary logarithm of the longest chain of renames
        up = link.select(F.col("child").alias("root"), F.col("root").alias("up"))
        nxt = s.put(link.join(up, "root", "left").select("child", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "links")
        moved = nxt.where("moved").limit(1).count()
        s.drop(link)
        link = nxt
        if not moved:
            break
    attrs = marked.withColumn("child", node(F.col("writer"), F.col("field"), F.col("since"))).join(link.select("child", "root"), "child", "left")
    attrs = attrs.select("writer", "file_seq", "file_id", "field", "kind", F.coalesce("root", "child").alias("root"))
    typed = carry_last(s, attrs.withColumn("akey", F.to_json("root")), ["writer", "akey"], ["file_seq", "file_id"], "kind", "kind_before")
    typed = s.put(typed, "typed")

    drift = lambda df, f, d, new=F.lit(None).cast("string"): df.select("writer", "file_seq", "file_id", F.col(f).alias("field_name"), F.lit(d).alias("drift"), new.alias("new_name"))
    k = ["writer", "file_seq", "file_id"]
    at = starts.where("before is not null")
    changes = (
        drift(at.where("new").join(renamed.select(*k, F.col("new").alias("field")), [*k, "field"], "left_anti"), "field", "added")
        .unionByName(drift(at.where("not new").join(renamed.select(*k, F.col("old").alias("field")), [*k, "field"], "left_anti"), "field", "removed"))
        .unionByName(drift(renamed, "old", "renamed", F.col("new")))
        .unionByName(drift(typed.where("kind <> kind_before"), "field", "retyped"))
    )
    return {"changes": changes, "attributes": typed.select("writer", "file_seq", "file_id", "field", F.col("root.field").alias("attribute"), "root", "kind"), "renamed": renamed, "pairs": pairs, "profile": per_file, "sketches": everywhere, "together": both_in}


def attribute_names(found: dict[str, DataFrame]) -> dict[str, tuple[str, dict[str, int]]]:
    """The attributes of all writers, from what schema_drift returns: canonical name -> (type, field names with their files).

    Schemas are matched one after the other, the most frequent first: a bipartite matching of a schema's unknown names
    with the attributes so far, weighed as renames are, by values, names and types over all writers; names that stand
    together in files are different attributes, and one that no attribute takes begins its own. The type is that of
    most values' fields: double, boolean or string, where arrays and objects are JSON text. An attribute is called by
    its most frequent name. Only names and their profiles come to the driver, at most MOST_NAMES of them.
    """
    p = found["profile"].where("field is not null")
    names = p.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "number").alias("number"), F.count_if(F.col("kind") == "boolean").alias("boolean"), F.count_if(F.col("kind") == "string").alias("string"), F.count("kind").alias("known"))
    kinds = {r["field"]: r for r in names.orderBy(F.desc("n"), "field").limit(MOST_NAMES + 1).collect()}
    if len(kinds) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} field names")
    of = names.select("field", F.when(F.col("known") > 0, F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("k")) for k in ("number", "boolean", "string")]))["k"]).alias("kind")).join(found["sketches"], "field", "left")
    a, b = of.toDF("f", "fk", "fs"), of.toDF("g", "gk", "gs")
    values = F.coalesce(ochiai(F.col("fs"), F.col("gs")), F.lit(0.0))
    weight = WEIGHTS["values"] * values + WEIGHTS["names"] * name_similarity(F.col("f"), F.col("g")) + WEIGHTS["types"] * type_similarity(F.col("fk"), F.col("gk"))
    share = found["together"]
    near = a.join(b, F.col("f") < F.col("g")).join(share, ["f", "g"], "left").select("f", "g", weight.alias("w"), F.coalesce("share", F.lit(0.0)).alias("share"))
    near = {frozenset((r["f"], r["g"])): (r["w"] * (1 - r["share"]), r["share"]) for r in near.where((F.col("w") >= LEAST_WEIGHT) | (F.col("share") > 0)).collect()}
    # of the schemas, for each name the most frequent one that has it
    files = p.groupBy("writer", "file_seq", "file_id").agg(F.array_sort(F.collect_set("field")).alias("names")).groupBy("names").agg(F.count("*").alias("n"))
    schemas = files.select(F.explode("names").alias("field"), "names", "n").groupBy("field").agg(F.max(F.struct("n", "names")).alias("s")).select("s.*").distinct().collect()
    attributes: list[list[str]] = []
    placed: set[str] = set()
    for s in sorted(schemas, key=lambda r: (-r["n"], r["names"])):
        unknown = [x for x in s["names"] if x not in placed]
        m = np.zeros((len(unknown), len(attributes)))
        for i, x in enumerate(unknown):
            for j, known in enumerate(attributes):
                got = [near.get(frozenset((x, y)), (0.0, 0.0)) for y in known]
                w = max(g[0] for g in got)
                m[i, j] = w if w >= LEAST_WEIGHT and max(g[1] for g in got) < MOST_TOGETHER else 0
        pairs = {i: j for i, j in best_matching(m) if m[i, j] > 0} if m.size else {}
        for i, x in enumerate(unknown):
            if i in pairs:
                attributes[pairs[i]].append(x)
            else:
                attributes.append([x])
            placed.add(x)
    out, taken = {}, {"record_id", "writer", "file_id", "other"}
    for names_ in sorted(attributes, key=lambda x: max(kinds[y]["n"] for y in x), reverse=True):
        names_ = sorted(names_, key=lambda y: (-kinds[y]["n"], y))
        best = max(("number", "boolean", "string"), key=lambda k: (sum(kinds[y][k] for y in names_), k))
        known = sum(kinds[y]["known"] for y in names_)
        kind = best if known and sum(kinds[y][best] for y in names_) * 2 >= known else "string"
        name = names_[0]
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out[name] = ({"number": "double"}.get(kind, kind), {y: kinds[y]["n"] for y in names_})
    return out


MOST_TOGETHER = 0.05  # names that stand together in more of the rarer one's files are different attributes


def unified(records: DataFrame) -> DataFrame:
    """All readable records of all writers as one table: a row per record, a typed column per attribute.

    Columns: record_id, writer, file_id, one for each of attribute_names, and ``other``, a map from field name to JSON
    text of what fits no column: values that aren't of their attribute's type, or second fields of an attribute. Numbers
    given as text, also with p for the point, count as numbers. The columns are a projection of the payload.
    """
    attributes = attribute_names(schema_drift(records))
    r = records.select("record_id", "writer", "file_seq", "file_id", "payload").where("payload is not null and writer is not null and file_seq is not null and file_id is not null").dropDuplicates(["record_id"])
    r = r.withColumn("v", F.try_parse_json("payload")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")

    parsed = F.from_json("payload", "map<string,string>")

    def get(name: str, kind: str) -> Column:
        quote = next((q for q in "'\"" if q not in name), None)
        if quote is None:  # a name with both quotes can't be in a path
            text = F.element_at(parsed, name)
            return text.try_cast(kind) if kind != "string" else text
        path = f"$[{quote}{name}{quote}]"
        text = F.try_variant_get("v", path, "string")
        if kind == "double":
            return F.coalesce(F.try_variant_get("v", path, "double"), F.when(text.rlike(r"^\s*[+-]?\d+p\d+\s*$"), F.replace(text, F.lit("p"), F.lit("."))).try_cast("double"))
        return F.try_variant_get("v", path, "boolean") if kind == "boolean" else text

    cols, used = [], []
    for name, (kind, names) in attributes.items():
        cols.append(F.coalesce(*[get(x, kind) for x in names]).alias(name))
        first = F.lit(False)
        for x in names:  # which field filled the column
            got = get(x, kind).isNotNull()
            used.append(F.when(got & ~first, F.lit(x)))
            first = first | got
    rest = F.map_filter(parsed, lambda k, v: v.isNotNull() & ~F.coalesce(F.array_contains("used", k), F.lit(False)))
    return r.select("record_id", "writer", "file_id", "payload", *cols, F.array_compact(F.array(*used) if used else F.array().cast("array<string>")).alias("used")).withColumn("other", rest).drop("payload", "used")
