"""Plans are applied whole or not at all, also where the writer dies between its steps."""

import pytest
from pyspark.sql import functions as F

from lodeframe.sources import changes


def files(spark, root):
    return {r.file: r.content for r in changes.current(spark, root).collect()}


def plan(spark, rows):
    return spark.createDataFrame(rows, "file string, expected string, content string")


def digest(spark, text):
    return spark.range(1).select(F.sha2(F.lit(text), 256)).first()[0]


@pytest.fixture
def root(spark, tmp_path):
    place = str(tmp_path / "project")
    assert files(spark, place) == {}
    assert changes.apply(spark, place, plan(spark, [("a", None, "one"), ("b", None, "two"), ("c", None, "")])).count() == 0
    return place


BEFORE = {"a": "one", "b": "two", "c": ""}


def test_applied_and_taken_back(spark, root):
    good = plan(spark, [("a", digest(spark, "one"), "ONE"), ("b", digest(spark, "two"), None), ("d", None, "new")])
    assert changes.apply(spark, root, good, dry_run=True).count() == 0 and files(spark, root) == BEFORE
    assert changes.apply(spark, root, good).count() == 0 and files(spark, root) == {"a": "ONE", "c": "", "d": "new"}
    # The plan is for files as they were: again it is refused.
    assert {tuple(r) for r in changes.apply(spark, root, good).collect()} == {("a", "changed since"), ("b", "missing"), ("d", "exists")}
    changes.take_back(spark, root, 1)
    assert files(spark, root) == BEFORE
    changes.take_back(spark, root, 2)
    assert files(spark, root) == {"a": "ONE", "c": "", "d": "new"}


def test_one_problem_refuses_all(spark, root):
    one = digest(spark, "one")
    bad = plan(spark, [("a", one, "x"), ("e", None, "1"), ("e", None, "2"), (None, None, "y"), ("f", None, "bad")])
    out = changes.apply(spark, root, bad, check=lambda content, file: F.when(content == "bad", F.concat(F.lit("in "), file)))
    assert sorted((str(r.file), r.problem) for r in out.collect()) == [("None", "no file"), ("e", "twice in the plan"), ("e", "twice in the plan"), ("f", "in f")]
    assert files(spark, root) == BEFORE
    assert changes.apply(spark, root, plan(spark, [])).count() == 0 and files(spark, root) == BEFORE


@pytest.mark.parametrize("step", ["publish", "half"])
def test_death_between_the_steps(spark, root, monkeypatch, step):
    good, real = plan(spark, [("a", digest(spark, "one"), "ONE")]), changes._publish

    def die(spark, root, number, versions):
        if step == "half":
            # The list is cut off.
            system, place = changes._files(spark, f"{root}/published/{number:08d}")
            out = system.create(place, False)
            out.write(bytearray(versions[-1][:9].encode()))
            out.close()
        raise OSError("killed")

    monkeypatch.setattr(changes, "_publish", die)
    with pytest.raises(OSError):
        changes.apply(spark, root, good)
    assert files(spark, root) == BEFORE
    monkeypatch.setattr(changes, "_publish", real)
    assert changes.apply(spark, root, good).count() == 0 and files(spark, root) == {**BEFORE, "a": "ONE"}


def test_two_writers(spark, root, monkeypatch):
    real = changes._publish

    def late(spark, root, number, versions):
        monkeypatch.setattr(changes, "_publish", real)
        changes.apply(spark, root, plan(spark, [("b", digest(spark, "two"), "other")]))
        real(spark, root, number, versions)

    monkeypatch.setattr(changes, "_publish", late)
    with pytest.raises(Exception, match="(?i)exists"):
        changes.apply(spark, root, plan(spark, [("a", digest(spark, "one"), "ONE")]))
    assert files(spark, root) == {**BEFORE, "b": "other"}
