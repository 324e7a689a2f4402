"""The best candidates are those of looking up every class, while few are looked up; ranks are those of sorting."""

import random

import pytest
from pyspark.sql import functions as F

from lodeframe.operators import candidates


def members(spark, n, seed):
    dice = random.Random(seed)
    rows = []
    for c in range(n):
        for _ in range(dice.choice([1, 2, 2, 3, 6])):
            rows.append((c, f"src/m{dice.randrange(40)}.py", "\n".join(["if a:"] * dice.randrange(3) + ["x"] * dice.choice([2, 5, 30, 200]))))
    return spark.createDataFrame(rows, "class_id long, file string, text string"), rows


def test_best_is_that_of_all(spark):
    rows, _ = members(spark, 300, 1)
    tests = spark.createDataFrame([(f"t/test_m{i}.py", f"import m{i + 1}") for i in range(0, 40, 3)] + [(None, None), ("t/m39.spec.ts", "")], "file string, text string")
    found = candidates.groups(rows)
    all_ = candidates.best(rows, tests, 10_000)
    n = found.count()
    assert all_.count() == n
    want = [r.asDict() for r in all_.orderBy("rank").collect()]
    assert {r["n_covered"] > 0 for r in want} == {True, False}
    assert candidates.possible(found, 7).count() < n
    for k in (1, 7, 20):
        assert candidates.best(rows, tests, k).orderBy("rank").collect() == [tuple(r.values()) for r in want[:k]]
        # No more are looked up than full coverage could lift to the k-th without any.
        known = sorted((r.known for r in found.collect()), reverse=True)
        assert candidates.possible(found, k).count() == sum(x + 25 >= known[k - 1] - 0.01 for x in known)


def test_coverage_by_name_and_by_word(spark):
    files = spark.createDataFrame([(1, "a/one.py"), (1, "b/one.py"), (1, "two.ts"), (2, "three.go"), (2, None), (3, "tw.py")], "class_id long, file string")
    tests = spark.createDataFrame([("test_one.py", None), ("x_test.go", "call(two, 3)"), ("three_test.go", "")], "file string, text string")
    assert {r.class_id: r.n_covered for r in candidates.coverage(files, tests).collect()} == {1: 3, 2: 1}


def test_scores_of_one_class(spark):
    rows = spark.createDataFrame([(5, "a.py", "x\n" * 99 + "x")] * 2 + [(5, None, None), (6, "a.py", "alone")], "class_id long, file string, text string")
    (row,) = candidates.best(rows, spark.createDataFrame([], "file string, text string")).collect()
    # 100 lines saved are 20 points of 100, no branch 100; three copies in two files leave 65.
    assert row.asDict() == {"rank": 1, "class_id": 5, "n_copies": 3, "n_files": 2, "lines_saved": 100, "n_covered": 0, "score": 37.75, "label": "low"}


def test_nothing(spark):
    none = spark.createDataFrame([], "class_id long, file string, text string")
    assert candidates.best(none, none.select("file", "text")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_ranks(spark, n):
    rows = spark.range(n).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    got = {r.id: r["rank"] for r in candidates.ranked(rows, [F.desc("v"), F.col("id")]).collect()}
    want = {r.id: i for i, r in enumerate(sorted(rows.collect(), key=lambda r: (-r.v, r.id)), 1)}
    assert got == want


def test_texts_are_not_for_the_driver_to_gather(spark, monkeypatch):
    monkeypatch.setattr(candidates.clones, "clone_classes", lambda rows: rows.select("id", F.col("id").alias("class_id")))
    monkeypatch.setattr(candidates, "best", lambda members, tests: members)
    plan = candidates._best(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
