"""The exact set join, the gate and the anchors against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import clones, search, setjoin


def sets_of(spark, sets):
    return spark.createDataFrame([(k, sorted(s)) for k, s in sets.items()], "node long, items array<long>")


@pytest.mark.parametrize("similarity", [0.3, 0.8, 1.0])
def test_every_pair_is_found(spark, similarity):
    r = random.Random(5)
    sets = {}
    for k in range(250):
        base = set(sets[r.randrange(k)]) if k and r.random() < 0.7 else {r.randrange(60) for _ in range(r.randrange(1, 25))}
        for _ in range(r.randrange(4)):
            base ^= {r.randrange(60)}
        sets[k] = base or {k}
    sets[900], sets[901] = set(), set()
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}
    got = setjoin.similar_sets(sets_of(spark, sets), similarity).collect()
    assert want and len(got) == len(want) and {(x.a, x.b): pytest.approx(x.similarity) for x in got} == want
    assert setjoin.similar_sets(sets_of(spark, sets).limit(0), similarity).count() == 0


def test_hot_elements_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "TOGETHER", 3)
    sets = {k: {1, 2, 3, 4, 5, 6, 7, 8, 9, 100 + k} for k in range(40)}
    assert setjoin.similar_sets(sets_of(spark, sets), 0.8).count() == 40 * 39 // 2


def test_threshold_out_of_range(spark):
    with pytest.raises(ValueError):
        setjoin.similar_sets(sets_of(spark, {1: {1}}), 0.0)


def test_shingles_are_those_of_the_search(spark):
    texts = ["def f(a, b): return a+1 # x", "", None, "one", "one two", "é ü 12ab_3", "a\n\tb  c"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.size(setjoin.token_shingles(F.col("text"))).alias("n")).collect()
    assert {r.text: r.n for r in rows} == {t: len(search.shingles(t or "")) for t in texts}


def plain_anchors(nodes, links):
    near, taken = {(a, b) for a, b in links}, {}
    for i, a in enumerate(nodes):
        if a not in taken:
            taken[a] = a
            taken.update({b: a for b in nodes[i + 1 :] if b not in taken and (a, b) in near})
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_anchors_are_those_of_the_loop(spark, seed):
    r = random.Random(seed)
    nodes = list(range(60))
    links = [(a, b) for a in nodes for b in nodes if a < b and r.random() < (0.02, 0.08, 0.3, 0.9)[seed]]
    got = setjoin.anchors(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long")).collect()
    assert {x.node: x.anchor for x in got} == plain_anchors(nodes, links) and len(got) == 60


def test_a_chain_of_links_in_order(spark):
    nodes, links = list(range(40)), [(k, k + 1) for k in range(39)]
    got = setjoin.anchors(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long")).collect()
    assert {x.node: x.anchor for x in got} == plain_anchors(nodes, links)


def test_clusters_stay_in_their_bucket(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]

    def text():
        return " ".join(w for w in words if r.random() < 0.97)

    items = [(b, k, text()) for b in ("x", "y") for k in range(25)] + [("x", 50, None), ("x", 51, None), ("y", 52, ""), ("y", 53, "")] + [("x", 60, "same here now"), ("x", 61, "same here now"), ("y", 62, "same here now")]
    got = {(x.bucket, x.id): (x.anchor, x.n_members) for x in setjoin.anchor_clusters(spark.createDataFrame(items, "bucket string, id long, text string"), 0.8).collect()}
    for bucket in "xy":
        own = {k: t for b, k, t in items if b == bucket}
        shingles = {k: search.shingles(t or "") for k, t in own.items()}
        links = {(a, b) for a in own for b in own if a < b and own[a] is not None and (own[a] == own[b] or len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) > 0)}
        want = plain_anchors(sorted(own), links)
        sizes = {a: list(want.values()).count(a) for a in want.values()}
        assert {k: got[bucket, k] for k in own} == {k: (a, sizes[a]) for k, a in want.items()}
    assert setjoin.anchor_clusters(spark.createDataFrame([], "bucket string, id long, text string"), 0.8).count() == 0


def test_gate_and_all_pairs(spark):
    rows = [("short", k, 5) for k in range(20)] + [("long", k, 50) for k in range(20)] + [("few", k, 50) for k in range(4)] + [("found", k, 5) for k in range(4)] + [("large", k, 5) for k in range(101)]
    items = spark.createDataFrame(rows, "bucket string, node long, tokens int")
    gate = setjoin.compare_all(items, spark.createDataFrame([("found",)], "bucket string"))
    assert {r.bucket: r.compare_all for r in gate.collect()} == {"short": True, "long": False, "few": True, "found": False, "large": False}
    pairs = [(r.bucket, r.a, r.b) for r in setjoin.all_pairs(items, gate).collect()]
    assert sorted(pairs) == sorted((b, x, y) for b, n in (("short", 20), ("few", 4)) for x in range(n) for y in range(x + 1, n))
    assert not setjoin.compare_all(items, spark.createDataFrame([("found",)], "bucket string"), enabled=False).filter("compare_all").count()


def test_links_are_all_pairs(spark):
    """No link is lost: as many as by comparing each function with each."""
    rows = [(r.id, r.text) for r in search._code(spark, "/root/testdata/sf0.01").filter("id <= 700").select("id", "text").collect()]
    sets = {i: search.shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = [(r.a, r.b) for r in clones.links(spark.createDataFrame(rows, "node long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def templates(r, n, common=30):
    """Sets of a common part, a few bundles that others have too, and now and then items of their own."""
    weights = [2, 6, 3, 3]
    sets = {}
    for k in range(n):
        base = set(range(common))
        for part, weight in enumerate(weights):
            at = 1000 * (part + 1) + 10 * r.randrange(20)
            base |= set(range(at, at + weight))
        for part in range(3):
            base |= set(range(9000 + 10 * part, 9000 + 10 * part + 4)) if r.random() < 0.5 else set()
        sets[k] = base | ({100000 + 10 * k, 100001 + 10 * k} if r.random() < 0.1 else set())
    return sets


def alike(sets, similarity):
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}


@pytest.mark.parametrize("similarity", [0.7, 0.8, 0.95])
def test_sets_of_few_bundles_need_no_candidates(spark, monkeypatch, similarity):
    """They meet on what they share, each pair once; none is left to the prefixes, where all with a common bundle meet."""
    sets = templates(random.Random(8), 400)
    sets[400], sets[401] = set(sets[7]), set(range(30))
    monkeypatch.setattr(setjoin, "candidates", lambda *_: pytest.fail("candidates by prefixes"))
    monkeypatch.setattr(setjoin, "TOGETHER", 7)
    want = alike(sets, similarity)
    got = setjoin.similar_sets(sets_of(spark, sets), similarity).collect()
    assert want and len(got) == len(want) and {(x.a, x.b): pytest.approx(x.similarity) for x in got} == want


@pytest.mark.parametrize("bits", [1, 4])
def test_sets_of_few_and_of_many_bundles(spark, monkeypatch, bits):
    """Pairs of both kinds, of one, and of the other; the most frequent items may not all have bits."""
    r = random.Random(9)
    sets = templates(r, 150, 30 if bits == 4 else 90)
    for k in range(150, 260):
        base = set(sets[r.randrange(k)])
        sets[k] = base | {r.randrange(70000, 70030) for _ in range(r.randrange(6))}
    monkeypatch.setattr(setjoin, "WORDS", bits)
    kinds = {x.node: len(x.rare) <= setjoin.MOST_BUNDLES for x in setjoin.bundled(sets_of(spark, sets)).collect()}
    want = alike(sets, 0.8)
    got = setjoin.similar_sets(sets_of(spark, sets), 0.8).collect()
    assert {(kinds[a], kinds[b]) for a, b in want} == {(x, y) for x in (True, False) for y in (True, False)}
    assert len(got) == len(want) and {(x.a, x.b): pytest.approx(x.similarity) for x in got} == want


def test_hashed_shingles_tell_sets_apart(spark):
    texts = ["a b c a b c a b", "ab c d", "a bc d", "a b", "ab", "a\u00a0b", "a b c d"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", setjoin.token_shingles(F.col("text")).alias("s")).collect()
    names = {}
    for x in rows:
        assert len(x.s) == len(set(x.s)) == len(search.shingles(x.text))
        names[x.text] = set(x.s)
    assert len(names["a b c d"] & names["a b c a b c a b"]) == 1
    assert not names["ab c d"] & names["a bc d"] and not names["a b"] & names["ab"]


@pytest.mark.parametrize("few", [6, 3])
def test_counts_and_classes_without_links(spark, monkeypatch, few):
    """As many links of each node, and the same classes, as by the links; with fewer bundles allowed some pairs go by prefixes."""
    sets = templates(random.Random(11), 160)
    sets |= {k: {x + 500000 for x in sets[k - 200]} for k in range(200, 230)}
    sets[300], sets[301] = set(sets[5]), set()
    monkeypatch.setattr(setjoin, "MOST_BUNDLES", few)
    monkeypatch.setattr(setjoin, "TOGETHER", 5)
    monkeypatch.setattr(setjoin, "similar_sets", lambda *_: pytest.fail("links are kept"))
    counts, edges = setjoin.link_counts(sets_of(spark, sets), 0.8)
    want = alike({k: s for k, s in sets.items() if s}, 0.8)
    degree = {k: sum(k in pair for pair in want) for k in sets}
    assert {x.node: x.n_links for x in counts.collect()} == {k: n for k, n in degree.items() if n}

    def classes(pairs):
        first = {k: k for k in sets}
        for _ in sets:
            for a, b in pairs:
                first[a] = first[b] = min(first[a], first[b])
        return first

    got = [(x.source, x.target) for x in edges.collect()]
    assert len(set(classes(want).values())) > 3 and classes(got) == classes(want) and all((min(e), max(e)) in want for e in got if few == 6)
