"""Plans of changes to the files of a project, applied as a whole or not at all.

A project is a folder with ``versions``, the changed files of each plan as Parquet, and ``published``, a small numbered file for each
plan, which lists the versions that hold. A plan is checked against the files as they are, written aside, read back, and only then
published: by creating the next number, which only one writer can do. Whatever fails before leaves all as it was, and what
it wrote is never read. A list that was cut off while it was written does not hold. Taking back publishes an older list anew.

The files of a plan are rows (file, expected, content): ``expected`` is the digest that the file has now, null if it must not exist;
null content removes it. A null file, one that is twice in the plan, and one that is not as expected are problems. An empty plan changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.plans import dialect
from lodeframe.session import _shared_folder, checkpoint

SCHEMA = "file string, content string, digest string, version string"


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _published(spark: SparkSession, root: str) -> tuple[int, dict[int, list[str]]]:
    """The last number taken, and the versions of each list that is whole: as many as plans were applied."""
    system, place = _files(spark, f"{root}/published")
    if not system.exists(place):
        return 0, {}
    taken = [int(s.getPath().getName()) for s in system.listStatus(place)]
    rows = spark.read.text(f"{root}/published", wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()
    lists = {int(r["name"]): r["value"].split() for r in rows if r["value"].endswith(".\n")}
    return max(taken, default=0), {n: ids[:-1] for n, ids in lists.items()}


def _publish(spark: SparkSession, root: str, number: int, versions: list[str]) -> None:
    """Fails if another has the number."""
    system, place = _files(spark, f"{root}/published/{number:08d}")
    out = system.create(place, False)
    try:
        out.write(bytearray(" ".join([*versions, ".\n"]).encode()))
    finally:
        out.close()


def _state(spark: SparkSession, root: str, versions: list[str]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], "file string, content string, digest string")
    rows = spark.read.schema(SCHEMA).parquet(*[f"{root}/versions/{v}" for v in versions])
    order = F.create_map(*[F.lit(x) for i, v in enumerate(versions) for x in (v, i)])
    newest = rows.groupBy("file").agg(F.max_by(F.struct("content", "digest"), order[F.col("version")]).alias("x"))
    return newest.select("file", "x.*").filter("content is not null")


def current(spark: SparkSession, root: str) -> DataFrame:
    """file, content, digest of the project's files."""
    lists = _published(spark, root)[1]
    return _state(spark, root, lists[max(lists)] if lists else [])


def problems(plan: DataFrame, now: DataFrame, check: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """file, problem of the plan's rows that can't be applied to the files ``now``; ``check`` says what is wrong with (content, file), null if nothing."""
    counted = plan.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("file")))
    found = counted.join(now.select("file", F.col("digest").alias("has")), "file", "left")
    problem = F.when(F.col("file").isNull(), "no file").when(F.col("times") > 1, "twice in the plan")
    problem = problem.when(F.col("expected").isNull() & F.col("has").isNotNull(), "exists").when(F.col("expected").isNotNull() & F.col("has").isNull(), "missing").when(F.col("expected") != F.col("has"), "changed since")
    wrong = F.lit(None).cast("string") if check is None else F.when(F.col("content").isNotNull(), check(F.col("content"), F.col("file")))
    return found.select("file", F.coalesce(problem, wrong).alias("problem")).filter("problem is not null")


def apply(spark: SparkSession, root: str, plan: DataFrame, check: Callable[[Column, Column], Column] | None = None, dry_run: bool = False) -> DataFrame:
    """Apply the whole plan if it has no problems, which are returned (file, problem); with any, or on a dry run, nothing is written."""
    last, lists = _published(spark, root)
    versions = lists[max(lists)] if lists else []
    plan = checkpoint(plan.select("file", "expected", "content"))
    found = checkpoint(problems(plan, _state(spark, root, versions), check))
    if dry_run or plan.isEmpty() or not found.isEmpty():
        return found
    version = uuid.uuid4().hex
    staged = f"{root}/versions/{version}"
    plan.select("file", "content", F.sha2("content", 256).alias("digest"), F.lit(version).alias("version")).write.parquet(staged)
    kept = spark.read.schema(SCHEMA).parquet(staged)
    # Digests made anew of what was read back, so that no text goes through a shuffle.
    lost = plan.select("file", F.sha2("content", 256)).exceptAll(kept.select("file", F.sha2("content", 256)))
    if not lost.isEmpty():
        raise OSError(f"{staged} is not what was written")
    _publish(spark, root, last + 1, [*versions, version])
    return found


def take_back(spark: SparkSession, root: str, number: int) -> None:
    """The files as they were when list ``number`` was published; 0 is before the first."""
    last, lists = _published(spark, root)
    _publish(spark, root, last + 1, lists[number] if number else [])


#: The corpus as files, and a plan: logging calls renamed, some files removed, some new.
_BASE = "select file || '#' || cast(construct_id as string_) as file, text, construct_id as id from code_ c"
_NEW = "select 'src/new/' || cast(construct_id as string_) || '.py' as file, 'pass' as content from code_ c where construct_id % 100 = 0"


def _plan(base: DataFrame, new: DataFrame) -> DataFrame:
    gone, own = F.col("id") % 11 == 0, F.sha2("text", 256).alias("expected")
    changed = base.filter(gone | F.col("text").contains("console.log")).select("file", own, F.when(~gone, F.replace("text", F.lit("console.log"), F.lit("logger.info"))).alias("content"))
    return changed.unionByName(new.select("file", F.lit(None).cast("string").alias("expected"), "content"))


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, digest after the plan."""
    root = f"{_shared_folder(spark)}/project-{uuid.uuid4().hex}"
    base = dialect.run(spark, sf_dir, _BASE)
    apply(spark, root, base.select("file", F.lit(None).cast("string").alias("expected"), F.col("text").alias("content")))
    apply(spark, root, _plan(base, dialect.run(spark, sf_dir, _NEW)))
    return current(spark, root).select("file", "digest")


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, problem of the same plan on files of which some have changed, gone or come since."""
    base, new = dialect.run(spark, sf_dir, _BASE), dialect.run(spark, sf_dir, _NEW)
    since = base.filter("id % 5 <> 0").select("file", F.sha2(F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("digest"))
    return problems(_plan(base, new), since.unionByName(new.filter("file like '%200.py'").select("file", F.sha2("content", 256).alias("digest"))))


FRAMES = {"l16_applied_plan": _applied, "l17_plan_problems": _refused}
_D = dialect.duck_sql
FRAME_ORACLES = {
    "l16_applied_plan": f"select file, sha256(replace(text, 'console.log', 'logger.info')) as digest from ({_D(_BASE)}) b where id % 11 <> 0 union all select file, sha256(content) from ({_D(_NEW)}) n",
    "l17_plan_problems": f"""select file, case when id % 5 = 0 then 'missing' else 'changed since' end as problem from ({_D(_BASE)}) b where (id % 11 = 0 or contains(text, 'console.log')) and (id % 5 = 0 or id % 3 = 0)
      union all select file, 'exists' from ({_D(_NEW)}) n where file like '%200.py'""",
}
