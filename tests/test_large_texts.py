"""What is small as a table and large as texts: no broadcasts, no squares of lengths, no pairs of a file's functions."""

import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodeframe.operators import code, reports, search

SF_DIR = "/root/testdata/sf0.001"
JOINS = ["a35_integrity", "c22_name_conflicts", "d33_edit_counts", "i28_edit_statistics", "j02_token_similarity", "j07_hybrid_similarity", "j08_line_similarity", "j09_precise_similarity", "j12_line_edits", "j14_unified_diff", "j15_varying_literals", "j16_varying_names", "j17_varying_conditions"]


@pytest.mark.parametrize("name", JOINS)
def test_texts_are_not_broadcast(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_hybrid_compares_once(spark):
    """The pairs are made once, not for those that are unlike and again for the others."""
    plan = entry.queries()["j07_hybrid_similarity"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1


def test_char_shingles(spark):
    texts = ["", "a", "ab", "abc", "abcd", "a|b\n$1\\c", "añ😀x\r\nz", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = [r.s for r in rows.select("id", code.char_shingles(F.col("text")).alias("s")).orderBy("id").collect()]
    assert got == [t if t is None else "|".join(t[i : i + 3] for i in range(max(len(t) - 2, 1))) for t in texts]


def test_char_shingles_of_a_long_text(spark):
    """Run after run cut out of this text took the square of its length."""
    rows = spark.range(1).select(F.repeat(F.lit("abcdefghij"), 100_000).alias("text"))
    began = time.time()
    assert rows.select(F.length(code.char_shingles(F.col("text")))).first()[0] == 4 * (1_000_000 - 2) - 1
    assert time.time() - began < 30


def test_innermost_scopes(spark):
    starts = [("f", 1), ("f", 1), ("f", 10), ("f", 40), ("g", 5), (None, 3)]
    points = [(0, "f", 1), (1, "f", 9), (2, "f", 40), (3, "f", 39), (4, "f", 71), (5, "g", 4), (6, "h", 5), (7, None, 3), (8, "f", 70), (9, "f", 9)]
    got = code.innermost(spark.createDataFrame(points, "id int, file string, at int"), spark.createDataFrame(starts, "file string, start_line int"))
    want = {(i, max(s)) for i, f, at in points if (s := [b for g, b in starts if f and g == f and b <= at <= b + 30])}
    assert {(r.id, r.scope_start) for r in got.collect()} == want and got.count() == len(want)


def test_scopes_of_many_functions_on_one_line(spark):
    """Each with each these would be 4 * 10**10 pairs."""
    rows = spark.range(200_000).select("id", F.lit("f").alias("file"), F.lit(3).alias("start_line"), F.lit(8).alias("at"))
    assert code.innermost(rows.select("id", "file", "at"), rows).agg(F.count("id"), F.max("scope_start")).first() == (200_000, 3)


def test_references_are_counted_first(spark):
    lines = [(1, "f", "x"), (2, "f", "x"), (3, "g", "x"), (4, "g", ""), (5, "g", "other"), (None, "h", "x"), (6, None, "y")]
    got = reports.references(spark.createDataFrame(lines, "construct_id int, file string, stem string"), spark.createDataFrame([("x",), ("x",), ("y",), ("z",)], "stem string"))
    assert sorted(map(tuple, got.collect())) == [("x", 3, 3), ("y", 1, 0), ("z", 0, 0)]
    plan = entry.queries()["c09_textual_references"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    # Below the join there is nothing but aggregates.
    assert plan.index("Join") < plan.index("Aggregate") < plan.index("Generate")


def test_hybrid_as_by_parts(spark):
    long = "\n".join(f"w{i} = {i}" for i in range(60))
    rows = spark.createDataFrame([(1, long, long.replace("w7 ", "v ")), (2, long, "a b c d"), (3, None, "a"), (4, "", "")], "id int, a string, b string")
    from lodeframe.functions import syntax

    got = {r.id: r for r in search.hybrid_similarity(rows).collect()}
    parts = {r.id: r for r in rows.select("id", search.token_similarity("a", "b").alias("t"), syntax.line_similarity("a", "b").alias("l")).collect()}
    for i, p in parts.items():
        assert (got[i].method, got[i].similarity) == (("hybrid", pytest.approx(0.4 * p.t + 0.6 * p.l)) if p.t >= 0.5 else ("minhash", p.t))


def test_nodes_of_trees_are_not_broadcast(spark):
    """Nodes are many times what the table that their texts are made from takes, and pack well besides."""
    from lodeframe.operators import treerules

    plan = treerules.code_by_rule(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
