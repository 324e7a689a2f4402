"""Clone classes against all pairs."""

from lodeframe.operators import clones, search

SF_DIR = "/root/testdata/sf0.01"


def test_links_against_all_pairs(spark):
    rows = [(r.id, r.text) for r in search._code(spark, SF_DIR).filter("id <= 700").select("id", "text").collect()]
    sets = {i: search.shingles(t) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(r.a, r.b): r.similarity for r in clones.links(spark.createDataFrame(rows, "node long, text string")).collect()}
    assert want and set(got) <= want and len(got) >= 0.9 * len(want)


def test_classes(spark):
    words = [f"w{i}" for i in range(60)]
    near = [" ".join(words[:k] + [f"new{k}"] + words[k + 1 :]) for k in range(20)]
    rows = [(i, t) for i, t in enumerate(near)] + [(100 + i, "same text here") for i in range(50)] + [(200, None), (201, None), (202, ""), (203, ""), (204, "alone"), (204, "zeta")]
    got = {r.id: r for r in clones.clone_classes(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert len(got) == 20 + 50 + 5
    assert {got[i].class_id for i in range(20)} == {0} and all(got[i].n_links for i in range(20))
    assert {(got[i].class_id, got[i].n_copies, got[i].n_links) for i in range(100, 150)} == {(100, 50, 0)}
    assert (got[200].class_id, got[201].class_id, got[203].class_id, got[204].class_id) == (200, 201, 202, 204)
    assert clones.clone_classes(spark.createDataFrame([], "id long, text string")).count() == 0
