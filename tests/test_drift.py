import json

import numpy as np

from mosaiq.operators import drift


def records(spark, files):
    """files: {(writer, seq): [payload, ...]}"""
    rows, n = [], 0
    for (w, q), payloads in files.items():
        for p in payloads:
            rows.append((n, hash((w, q)) % 10**9, w, q, p if p is None or isinstance(p, str) else json.dumps(p), "clash"))
            n += 1
    return spark.createDataFrame([*rows, rows[0]] if rows else [], "record_id long, file_id long, writer string, file_seq int, payload string, field string")


def changes(spark, files):
    return {(r["writer"], r["file_seq"], r["field_name"], r["drift"], r["new_name"]) for r in drift.schema_drift(records(spark, files))["changes"].collect()}


def test_all_kinds(spark):
    sections = [f"KV-{i}.01" for i in range(6)]
    files = {
        ("a", 1): [{"section": s, "k": i} for i, s in enumerate(sections)],
        ("a", 3): [{"section_name": s, "k": str(i), "seed": 42} for i, s in enumerate(sections)],
        ("a", 7): [{"section_name": s, "k": str(i)} for i, s in enumerate(sections)] + [None, "{broken"],
        ("b", 1): [{"x": None}, {"x": 1}],
        ("b", 2): [{"X": "1"}],
        ("c", 1): [{"q": 1}],
    }
    got = changes(spark, files)
    assert got == {
        ("a", 3, "section", "renamed", "section_name"),
        ("a", 3, "k", "retyped", None),
        ("a", 3, "seed", "added", None),
        ("a", 7, "seed", "removed", None),
        ("b", 2, "x", "renamed", "X"),
        ("b", 2, "X", "retyped", None),
    }


def test_type_is_compared_with_last_file_that_has_values(spark):
    files = {("a", 1): [{"x": 1}], ("a", 2): [{"x": None}], ("a", 3): [{"x": 2}, {"x": 3}, {"x": "stray"}], ("a", 4): [{"x": [1]}]}
    assert changes(spark, files) == {("a", 4, "x", "retyped", None)}


def test_empty_and_unreadable(spark):
    assert changes(spark, {}) == set()
    assert changes(spark, {("a", 1): [None], ("a", 2): ["[1]", "nonsense"]}) == set()


def test_unified(spark):
    """Two writers that begin with different names and types end in one typed column each."""
    s = [f"KV-{i}.01" for i in range(6)]
    files = {
        ("a", 1): [{"section": x, "resolution": i / 4, "on": True} for i, x in enumerate(s)],
        ("a", 2): [{"section_name": x, "resolution": f"{i}p250"} for i, x in enumerate(s)],
        ("b", 1): [{"section_name": x, "Resolution": i / 4, "Writer": [1, 2]} for i, x in enumerate(s)] + [{"Resolution": "high", "it's": {"a": 1}}, None, "[]"],
    }
    u = drift.unified(records(spark, files))
    assert dict(u.dtypes) == {"record_id": "bigint", "writer": "string", "file_id": "bigint", "section_name": "string", "resolution": "double", "on": "boolean", "Writer_": "string", "it's": "string", "other": "map<string,string>"}
    got = {r["record_id"]: r for r in u.collect()}
    assert len(got) == 19
    assert [got[i]["section_name"] for i in range(18)] == s * 3
    assert [got[i]["resolution"] for i in range(18)] == [i / 4 for i in range(6)] + [i + 0.25 for i in range(6)] + [i / 4 for i in range(6)]
    assert got[18]["resolution"] is None and got[18]["other"] == {"Resolution": "high"} and got[18]["it's"] == '{"a":1}'
    assert got[12]["Writer_"] == "[1,2]" and got[0]["on"] and got[0]["other"] == {}
    assert drift.unified(records(spark, {("a", 1): ["{}"]})).columns == ["record_id", "writer", "file_id", "other"]


def test_types_tell_fields_apart(spark):
    """Equal values under names alike: the field of the same type goes on."""
    files = {("a", 1): [{"size_a": i} for i in range(4)], ("a", 2): [{"size_b": str(i), "size_c": i} for i in range(4)]}
    assert changes(spark, files) == {("a", 2, "size_a", "renamed", "size_c"), ("a", 2, "size_b", "added", None)}


def test_names_that_stand_together_are_no_renames(spark):
    files = {("a", 1): [{"env_k": 20}], ("a", 2): [{"clust_k": 20}]} | {("b", i): [{"env_k": 20, "clust_k": 20}] for i in range(5)}
    assert changes(spark, files) == {("a", 2, "env_k", "removed", None), ("a", 2, "clust_k", "added", None)}


def test_matching_is_optimal():
    from itertools import permutations

    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (2, 3), (4, 2), (4, 4), (3, 6)):
        w = rng.random((n, m))
        got = sum(w[i, j] for i, j in drift.best_matching(w))
        small, big = (w, m) if n <= m else (w.T, n)
        best = max(sum(small[i, p[i]] for i in range(small.shape[0])) for p in permutations(range(big), small.shape[0]))
        assert abs(got - best) < 1e-9
