"""Filters before verification leave out most pairs that are unlike, and none that is alike."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodeframe.operators import search, setjoin

SF_DIR = "/root/testdata/sf0.01"


def test_candidates_of_code_are_few(spark):
    """Texts of one template share frequent runs; without parities there are over twenty candidates for each link."""
    code = search._code(spark, SF_DIR).groupBy("text").agg(F.min("id").alias("node"))
    ordered = setjoin.rarest_first(code.select("node", setjoin.token_shingles(F.col("text")).alias("items")))
    pairs = {(r.a, r.b) for r in setjoin.candidates(ordered, 0.8).collect()}
    sets = {r.node: set(r["items"]) for r in ordered.collect()}
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(want) == 1233 and len(pairs) < 3 * len(want)


def test_items_that_go_together(spark):
    """Blocks of items with the same holders, of which only the first is met on."""
    rnd = random.Random(3)
    blocks = [[1000 * i + j for j in range(rnd.randint(1, 8))] for i in range(12)]
    sets = {n: sorted({x for b in rnd.sample(blocks, 7) for x in b} | {rnd.randrange(10**6, 10**6 + 5)}) for n in range(150)}
    got = {(r.a, r.b) for r in setjoin.similar_sets(spark.createDataFrame(list(sets.items()), "node long, items array<long>"), 0.7).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.7 * len(set(sets[a]) | set(sets[b]))}
    assert want and got == want


def test_search_finds_what_signatures_say(spark):
    rows = [(r.id, r.text) for r in search._code(spark, SF_DIR).filter("id < 600").select("id", "text").collect()]
    df = spark.createDataFrame(rows, "id long, text string")
    sigs = {i: np.array(search._signature(t)) for i, t in rows}
    for least in (0.6, 0.8):
        share = lambda x, y: any((x[k : k + 4] == y[k : k + 4]).all() for k in range(0, 128, 4))
        want = {(q, i): m for q in sigs if q % 10 == 0 for i in sigs if i != q and (m := float(np.mean(sigs[q] == sigs[i]))) >= least and share(sigs[q], sigs[i])}
        got = {(r.query_id, r.id): r.similarity for r in search.similar_to(df.filter("id % 10 = 0"), df, least).collect()}
        assert want and got == want


def test_sketches_bound_the_difference(spark):
    rnd = np.random.default_rng(5)
    x = rnd.integers(-(2**63), 2**63, (50, 128))
    y = np.where(rnd.random((50, 128)) < 0.2, rnd.integers(-(2**63), 2**63, (50, 128)), x)
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y)], "x array<long>, y array<long>")
    df = df.select("x", "y", *search.sketch(F.col("x")), *[c.alias(f"q{i}") for i, c in enumerate(search.sketch(F.col("y")))])
    for r in df.select("x", "y", search._differing().alias("n")).collect():
        bits = sum((a & 3) != (b & 3) for a, b in zip(r.x, r.y))
        assert r.n == bits <= sum(a != b for a, b in zip(r.x, r.y))
