import random

import pytest
from pyspark.sql import functions as F

from mosaiq.llm import languages, mixing, packing


def packed(spark, sizes, cap):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n long, bin string")
    return [tuple(r) for r in packing.pack(df, "doc_id", "n", cap).select("id", "piece", "n_pieces", "size", "bin").collect()]


@pytest.mark.parametrize("sizes", [[], [0, 0, None], [5], [100] * 40, [250], [1] * 300, [37] * 90 + [63] * 80 + [120, 200, 0, None]])
def test_pack_small(spark, sizes):
    got = packed(spark, sizes, 100)
    by, fill = {}, {}
    for i, piece, n, size, b in got:
        by.setdefault(i, []).append((piece, size))
        fill[b] = fill.get(b, 0) + size
    assert len(by) == len(sizes)
    for i, s in enumerate(sizes):
        s = s or 0
        assert sum(x for _, x in by[i]) == s and len(by[i]) == max(1, -(-s // 100))
    assert all(f <= 100 for f in fill.values())


def test_pack_fill(spark):
    random.seed(1)
    sizes = [min(100, int(random.expovariate(1 / 25)) + 1) for _ in range(800)]
    got = packed(spark, sizes, 100)
    assert sum(sizes) / 100 / len({r[4] for r in got}) > 0.95


def test_mix(spark):
    rows = [(i, s, 50 + i % 100) for i, s in enumerate(["web shop"] * 700 + ["B"] * 200 + ["c_c"] * 60 + ["other"] * 100 + [None] * 5)]
    docs = spark.createDataFrame([*rows, (None, "B", 5)], "doc_id long, source string, n long")
    targets = spark.createDataFrame([("Web-Shop", 0.4, 1), ("b", 0.3, 4), ("cc", 0.3, 2), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    r = mixing.mix(docs, targets, "doc_id", "source", "n", block=500)
    rep = {x["source"]: x for x in r["report"].collect()}
    assert [s for s, x in rep.items() if x["short"]] == ["cc"]
    used = {(x["source"], x["id"]): x["count"] for x in r["drawn"].groupBy("source", "id").count().collect()}
    assert max(n for (s, _), n in used.items() if s == "Web-Shop") == 1
    assert max(n for (s, _), n in used.items() if s == "cc") <= 2
    ratio = rep["Web-Shop"]["drawn_share"] / rep["b"]["drawn_share"]
    assert abs(ratio - 4 / 3) < 0.15
    early = r["drawn"].where("slot < 60").groupBy("source").agg(F.sum("size").alias("s")).collect()
    assert len(early) == 3  # sources are interleaved


def test_mix_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, n long")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    r = mixing.mix(docs, targets, "doc_id", "source", "n")
    assert r["drawn"].count() == 0 and r["report"].count() == 1


@pytest.mark.parametrize(("label", "want"), [("en", "en"), ("EN-gb", "en"), ("deu", "de"), ("ger", "de"), ("Swedish", "sv"), ("pt_BR", "pt"), ("fi", None), ("", None), (None, None), ("??", None)])
def test_labels(label, want):
    assert languages.label_language(label) == want


def test_automaton_against_brute_force():
    random.seed(3)
    text = "".join(random.choice("abc") for _ in range(200))
    a = languages.Automaton(text)
    for _ in range(50):
        q = "".join(random.choice("abcd") for _ in range(30))
        i, want = 0, []
        while i < len(q):
            j = i
            while j < len(q) and q[i : j + 1] in text:
                j += 1
            want.append(max(1, j - i))
            i += want[-1]
        assert a.phrases(q) == want


EN = ["the battery lasts longer than I thought and the lid feels solid in the hand", "my sister ordered one after she had tried mine", "the manual was a complete letdown for our small workshop", "I would write again when I have used it longer"]
DE = ["der akku hält länger als gedacht und der deckel liegt gut in der hand", "meine schwester hat sich danach auch eins bestellt", "die anleitung war eine große enttäuschung für unsere kleine werkstatt", "ich melde mich wieder wenn ich es länger benutzt habe"]


def test_passages(spark):
    train = [(i, (EN if i % 2 else DE)[i // 2 % 4], "en" if i % 2 else "German") for i in range(80)] + [(100, EN[1], "de")]
    schema = "doc_id long, text string, lang string"
    corpora = languages.fit(spark.createDataFrame(train, schema))
    assert set(corpora) == {"en", "de"} and "sister" not in corpora["de"]
    docs = [
        (1, f"{EN[0]}. {DE[1]}. {EN[2]}", "en"),
        (2, EN[3].upper(), None),
        (3, "<br>".join([DE[0], DE[2]]), "en"),
        (4, EN[1], "en-GB"),
        (5, f"{EN[1]} schwester", "en"),
        (6, "👍 10/10", None),
        (7, None, "en"),
        (8, "", None),
        (9, EN[0] + " " + ". ".join(EN * 3000), "eng"),
        (None, EN[0], None),
    ]
    df = spark.createDataFrame(docs, schema).withColumn("passage", F.lit("clash"))
    p = languages.passages(df, corpora)
    got = {(r["id"], r["lang"]) for r in languages.label_errors(p).collect()}
    assert got == {(1, "en"), (1, "de"), (2, "en"), (3, "de")}
    assert all(0 <= r["confidence"] <= 1 for r in p.collect())
    assert [r["lang"] for r in p.where("id = 1").orderBy("passage").collect()] == ["en", "de", "en"]


def test_pack_repeated_ids(spark):
    rows = [(i, 10 + i) for i in range(30)] * 2 + [(0, 3), (100, 60), (100, 60), (100, 55), (200, 250), (200, 250), (300, 0), (300, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), "doc_id", "n", 100).collect()
    pieces = sorted((r["id"], r["piece"], r["size"]) for r in got)
    assert pieces == [*((i, 1, 10 + i) for i in range(30)), (100, 1, 60), (200, 1, 100), (200, 2, 100), (200, 3, 50), (300, 1, 0)]
    fill = {}
    for r in got:
        fill[r["bin"]] = fill.get(r["bin"], 0) + r["size"]
    assert max(fill.values()) <= 100
