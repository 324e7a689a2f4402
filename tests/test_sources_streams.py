"""Sources, sinks and streams on small files."""

import datetime
import json

import pytest

from lodeframe.sources import files as src
from lodeframe.streaming import usage as streams


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    texts = {"a.py": "x = 1\ny = 2\n", "b.ts": "let x", "pkg/c.py": "z", "node_modules/d.py": "n", ".git/e.py": "g", "pkg/.hidden.py": "h", "big.py": "#" * 5000, "empty.py": "", "doc.md": "---\ntitle: \"T\"\n@type: Article\n---\nbody"}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def names(df):
    return sorted(r.file for r in df.select("file").collect())


def test_files(spark, project):
    assert names(src.files(spark, project, "python")) == ["a.py", "big.py", "empty.py", "pkg/c.py"]
    assert names(src.files(spark, project, "python", max_bytes=100)) == ["a.py", "empty.py", "pkg/c.py"]
    assert names(src.skipped_files(spark, project, 100, language="python")) == ["big.py"]
    assert names(src.skipped_files(spark, project, 0)) == []
    assert names(src.files(spark, project, include=["**/*.py"], exclude=["pkg/**"])) == ["a.py", "big.py", "empty.py"]
    assert names(src.files(spark, project, "python", globs={"python": ["*.ts"]})) == ["a.py", "b.ts", "big.py", "empty.py", "pkg/c.py"]


def test_lines_and_statistics(spark, project):
    found = src.files(spark, project, include=["a.py", "empty.py"])
    assert sorted(map(tuple, src.lines(found).collect())) == [("a.py", 1, "x = 1"), ("a.py", 2, "y = 2"), ("a.py", 3, ""), ("empty.py", 1, "")]
    assert sorted(map(tuple, src.statistics(found).collect())) == [("a.py", 12, 3), ("empty.py", 0, 1)]
    assert sorted(map(tuple, src.front_matter(src.files(spark, project, "markdown")).collect())) == [("doc.md", "@type", "Article"), ("doc.md", "title", "T")]


def test_matches_commits_vocabulary(spark, tmp_path):
    place = {"start": {"line": 1, "column": 2}, "end": {"line": 3, "column": 4}}
    (tmp_path / "m.json").write_text(json.dumps({"text": "t", "file": "f", "range": place, "metaVariables": {"A": 1}}) + "\nnot json\n{}\n")
    (row,) = src.matches(spark, str(tmp_path / "m.json")).collect()
    assert (row.text, row.file, row.range.end.column, row.metaVariables) == ("t", "f", 4, '{"A":1}')
    (tmp_path / "log").write_text("ab|abcd|N|n@x|2024-01-02T03:04:05+00:00|fix: a|body | more\nline---COMMIT---\ncd|cdef|M|m@x|bad|docs: b|---COMMIT---\n")
    rows = sorted(src.commits(spark, str(tmp_path / "log")).collect(), key=lambda r: r.short)
    assert [(r.short, r.subject, r.body) for r in rows] == [("ab", "fix: a", "body | more\nline"), ("cd", "docs: b", "")]
    assert rows[0].date == datetime.datetime(2024, 1, 2, 3, 4, 5) and rows[1].date is None
    (tmp_path / "v.json").write_text(json.dumps({"@graph": [{"@id": "a", "@type": ["X", "Y"], "rdfs:label": "A"}, {"@id": "b", "@type": "X"}]}))
    assert sorted((r.id, r.types, r.label) for r in src.vocabulary(spark, str(tmp_path / "v.json")).collect()) == [("a", ["X", "Y"], "A"), ("b", ["X"], None)]


def test_snapshots(spark, project, tmp_path):
    place, found = str(tmp_path / "snap"), src.files(spark, project, "python")
    src.save_snapshot(found, place, "s1")
    src.save_snapshot(found.filter("file = 'a.py'"), place, "s2")
    assert [tuple(r) for r in src.snapshots(spark, place).collect()] == [("s2", 1, 12), ("s1", 4, 5013)]
    assert all(r.intact for r in src.intact(spark, place, "s1").collect())
    assert bytes(src.restore_snapshot(spark, place, "s2").first().content) == b"x = 1\ny = 2\n"


def test_log_and_runs(spark, tmp_path):
    place = str(tmp_path / "log")
    for day in (1, 2):
        src.append_log(spark.createDataFrame([(day, datetime.datetime(2024, 1, day), "t", day == 1)], "event_id int, ts timestamp, tool string, success boolean"), place)
    assert [r.event_id for r in src.recent_logs(spark, place, 1).collect()] == [2]
    assert [r.event_id for r in src.recent_logs(spark, place, success=True, tool="t").collect()] == [1]
    src.store_run(spark.createDataFrame([(1,)], "run int"), spark.createDataFrame([(1, "f"), (1, "g")], "run int, name string"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs/function_metrics")).count() == 2
    known = spark.createDataFrame([("a",)], "path string")
    assert [r.path for r in src.new_projects(spark.createDataFrame([("a",), ("b",), ("b",)], "path string"), known).collect()] == ["b"]


def test_streams(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("append").parquet(str(tmp_path / "in"))
    events = streams.event_stream(spark, str(tmp_path / "in"))
    query = streams.append_operations(events, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    query = streams.alert_windows(events).writeStream.format("memory").queryName("alerts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("alerts").collect())) == sorted(map(tuple, streams.alerts_now(spark, sf).collect()))
    assert spark.table("alerts").count() > 0
