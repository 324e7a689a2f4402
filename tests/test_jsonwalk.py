"""JSON walks against a plain recursion."""

import json

from pyspark.sql import functions as F

from lodeframe.operators import jsonwalk

ROWS = "doc long, text string"


def plain(value, path=""):
    if isinstance(value, dict):
        if set(value) == {"@id"}:
            return [(path, value["@id"])]
        return [x for k, v in value.items() if k != "@id" for x in plain(v, f"{path}.{k}" if path else k)]
    return [x for i, v in enumerate(value) for x in plain(v, f"{path}[{i}]")] if isinstance(value, list) else []


def deep(n):
    value = {"@id": "#end"}
    for k in range(n):
        value = [0, value] if k % 2 else {"in": value, "@id": "#other"}
    return value


def test_references(spark):
    values = [deep(50), {"@id": "#top"}, [{"@id": "a"}, {"@id": "b", "x": 1}, [], {}], {"a b": {"@id": "é"}, "n": None, "t": True, "f": 1.5}, 7, None, "text", [[[{"@id": "x"}]], {"y": [{"@id": "z"}]}]]
    texts = [json.dumps(v) for v in values] + ['{"a": {"@id": "x"}', "", "  ", None, "{'a': 1}", " \n[{\"@id\": \"padded\"}]\t ", json.dumps(values[2])]
    want = []
    for k, text in enumerate(texts):
        try:
            want += [(k, p, i) for p, i in plain(json.loads(text or ""))]
        except json.JSONDecodeError:
            pass
    got = jsonwalk.id_references(spark.createDataFrame(list(enumerate(texts)), ROWS))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 8
    assert jsonwalk.id_references(spark.createDataFrame([], ROWS)).count() == 0


def test_ids_of_any_type(spark):
    got = jsonwalk.id_references(spark.createDataFrame([(1, '{"a": {"@id": 5}, "b": {"@id": null}}')], ROWS)).collect()
    assert {(r.path, r.id) for r in got} == {("a", "5"), ("b", None)}


def test_parse_or_null(spark):
    texts = ['{"a": 1}', "[1", None, "", " 5 ", "nul", "null"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], ROWS).select("doc", jsonwalk.parse_or_null(F.col("text")).isNotNull().alias("ok")).collect()
    assert {r.doc: r.ok for r in rows} == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False, 6: True}
