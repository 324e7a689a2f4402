"""Parsers, signatures and their index, patterns and fixes against plain versions."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodeframe.functions import syntax
from lodeframe.operators import graph, search

# The smallest tables have no two functions that are alike.
SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(search.FRAMES))
def test_rows(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_balance():
    assert syntax.balance_error("f(a[1], {')': \"]\"})") is None
    assert syntax.balance_error("a\n)") == "unexpected ) in line 2"
    assert syntax.balance_error("(]") == "unexpected ] in line 1"
    assert syntax.balance_error("{(") == "unclosed ("
    assert syntax.balance_error("") is None


def test_parsers(spark):
    text = "import os\n@d(1)\ndef f(a, b=2, *, c):\n    for i in a:\n        g(i)\n    return h(b)\n\nX = 1\n"
    df = spark.createDataFrame([(1, text), (2, "def ("), (3, None), (4, "")], "id int, text string")
    df = df.withColumn("nodes", syntax.tree("text"))
    rows = {r.id: r for r in df.select("id", syntax.signatures("text").alias("s"), syntax.python_surface("text").alias("p"), syntax.syntax_errors("text", F.lit("python")).alias("e"), syntax.inside(F.col("nodes"), "Call", "For").alias("c")).collect()}
    (f,) = rows[1].s
    assert (f.name, f.start, f.end, f.params, f.decorators) == ("f", 3, 6, ["a", "b", "c"], ["d(1)"])
    assert rows[1].p == "import os\n@d(1)\ndef f(a, b=2, *, c): ...\nX = 1"
    assert [n.line for n in rows[1].c] == [5]
    assert rows[1].e is None and rows[2].e and rows[3].e is None and rows[4].e is None
    assert rows[2].s == rows[3].s == rows[4].s == [] and rows[3].p is None


def test_edits(spark):
    df = spark.createDataFrame([("a\nb\nc", "a\nx\nc"), (None, "a")], "a string, b string")
    got = df.select(syntax.line_edits("a", "b")["kind"].alias("k"), syntax.unified_diff("a", "b", F.lit("f")).alias("d"), syntax.line_similarity("a", "b").alias("s")).collect()
    assert got[0].k == ["equal", "replace", "equal"] and "-b\n+x" in got[0].d and got[0].s == pytest.approx(0.8)
    assert got[1].s is None


def test_similar_search_against_all_pairs(spark):
    rows = [(r.id, r.text) for r in search._code(spark, SF_DIR).select("id", "text").collect()]
    sets = {i: search.shingles(t) for i, t in rows}
    want = {(q, i) for q in sets if q % 100 == 0 for i in sets if i != q and len(sets[q] & sets[i]) >= 0.8 * len(sets[q] | sets[i])}
    df = spark.createDataFrame([*rows, (-1, None), (-2, ""), (-3, " ")], "id long, text string")
    # Estimates stray, so the search is asked for somewhat less than what is compared.
    got = {(r.query_id, r.id) for r in search.similar_to(df.filter("id % 100 = 0"), df, 0.7).collect()}
    assert want and len(want & got) >= 0.9 * len(want)
    assert not [p for p in got if p[1] < 0]


def test_token_similarity(spark):
    long = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(long, long), (long, "x " * 50), ("a b", "a c"), (None, "a"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(search.token_similarity("a", "b")).collect()] == [1.0, 0.0, 0.5, 0.0, 0.0]


def test_patterns_and_fixes(spark):
    lines = spark.createDataFrame([("f", 1, "  foo(a, a)"), ("f", 2, "foo(a, b)"), ("f", 3, "bar"), ("g", 1, "")], "file string, line_no int, line string")
    (got,) = search.find_code(lines, "foo($A, $A)").collect()
    assert (got.line_no, got.column, got.text, got.variables) == (1, 2, "foo(a, a)", {"A": "a"})
    assert search.find_code(lines, "foo($$$ARGS)").count() == 2 and search.find_code(lines, "bar").first().variables == {}
    fixes = spark.createDataFrame([("f", 1, "x\ny"), ("f", 3, None), ("h", 1, "z")], "file string, line_no int, replacement string")
    assert sorted(map(tuple, search.apply_fixes(lines, fixes).collect())) == [("f", "x\ny\nfoo(a, b)"), ("g", "")]


def test_graphs_on_cycles_and_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (None, 6), (7, 7), (1, 2)], "source long, target long")
    entries = spark.createDataFrame([(1,), (1,), (None,)], "node long")
    assert sorted(map(tuple, graph.reachable(edges, entries).collect())) == [(1, 0), (2, 1), (3, 2)]
    assert sorted(map(tuple, graph.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (7, 7)]
    assert graph.reachable(edges.limit(0), entries.limit(0)).count() == 0 and graph.components(edges.limit(0)).count() == 0


def test_rewrites_and_hybrid(spark):
    lines = spark.createDataFrame([(1, "  a = f(x, y) + f(1, 2)"), (2, "g()")], "id int, line string")
    assert [tuple(r)[2] for r in search.rewrite_code(lines, "f($A, $B)", "$B.g($A, '$5\\n')").collect()] == ["  a = y.g(x, '$5\\n') + 2.g(1, '$5\\n')"]
    long = "\n".join(f"w{i} = {i}" for i in range(60))
    pairs = spark.createDataFrame([(1, long, long), (2, long, "a b c d"), (3, None, "a")], "id int, a string, b string")
    assert [(r.id, r.method) for r in search.hybrid_similarity(pairs).orderBy("id").collect()] == [(1, "hybrid"), (2, "minhash"), (3, "minhash")]


def test_estimates_do_not_grow_over_the_rounds_of_components(spark):
    """A join is estimated at the product of its sides: kept from round to round, its digits double each time."""
    chain = spark.range(60).select(F.xxhash64("id").alias("source"), F.xxhash64(F.col("id") + 1).alias("target"))
    found = graph.components(chain)
    assert found.count() == 61 and found.select("class").distinct().count() == 1
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**40
