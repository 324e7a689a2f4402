"""Candidates for refactoring: classes of copies by score, and exact ranks of whole tables.

A class is worth what its copies would save, how simple they are, how well tests cover its files and how little there is to
change. All but the coverage is known from the class alone, and coverage can add so much at most: classes that
even with full coverage stay below the k best without any can't be among the k best, and are not looked up in the tests. The result is
that of looking up all.

Null files count as one file without a name that no test covers; null texts have no lines. Classes of one member are none.
Equal scores go by the least class. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.operators import clones
from lodeframe.operators.search import _code
from lodeframe.plans import dialect
from lodeframe.session import checkpoint

# Weights of the score, lines that save a point, what a branch, a copy and a file cost, and how many candidates are shown.
SAVINGS, COMPLEXITY, RISK, EFFORT = 0.40, 0.20, 0.25, 0.15
LINES_A_POINT, BRANCH, COPY, FILE = 5, 16.67, 5, 10
MOST = 100
# The least score of each label.
LABELS = [(80, "critical"), (60, "high"), (40, "medium"), (20, "low")]

TEST_FILE = r"(^|/)(test_[^/]*|[^/]*(_test|[.]test|[.]spec)[.][^/]*)$"
BRANCHES = r"\b(if|for|while|except|case|and|or)\b"


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with rank, from 1, in this order, which should leave few ties: ties are ranked in any order, and in one task.

    Rows are dealt to ranges of the order and ranked within each; what stands before a range is a sum over ranges, so no task
    sees more than one range.
    """
    dealt = checkpoint(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each range.
    before = sizes.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    own = dealt.withColumn("__own", F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return own.join(F.broadcast(before), "__range").select(*rows.columns, (F.col("__own") + F.col("__before")).alias("rank"))


def groups(members: DataFrame) -> DataFrame:
    """class_id, n_copies, n_files, lines_saved, branches, known (the score without coverage) of classes of rows (class_id, file, text)."""
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    branches = F.coalesce(F.regexp_count("text", F.lit(BRANCHES)), F.lit(0)).cast("long")
    # Files first, so that a large class is counted in parts.
    files = members.groupBy("class_id", "file").agg(F.count(F.lit(1)).alias("n"), F.sum(lines).alias("lines"), F.max(lines).alias("most"), F.min(branches).alias("branches"))
    found = files.groupBy("class_id").agg(F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("n_files"), (F.sum("lines") - F.max("most")).alias("lines_saved"), F.min("branches").alias("branches"))
    savings = F.least(F.col("lines_saved") / LINES_A_POINT, F.lit(100.0)) * SAVINGS
    simple = F.greatest(F.lit(0.0), 100 - F.col("branches") * BRANCH) * COMPLEXITY
    effort = F.greatest(F.lit(0), 100 - (F.col("n_copies") * COPY + F.col("n_files") * FILE)) * EFFORT
    return found.filter("n_copies > 1").withColumn("known", savings + simple + effort)


def rounded(score: Column) -> Column:
    return F.round(score + 1e-9, 2)


def possible(found: DataFrame, k: int) -> DataFrame:
    """The rows of ``groups`` that can be among the k best, whatever their coverage."""
    least = found.orderBy(F.desc("known"), "class_id").limit(k).agg(F.min("known").alias("least"), F.count(F.lit(1)).alias("n")).first()
    return found if least.n < k else found.filter(rounded(F.col("known") + 100 * RISK) >= rounded(F.lit(least.least)))


def stem(file: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file, "^.*/", ""), "[.][^.]*$", "")


def coverage(files: DataFrame, tests: DataFrame) -> DataFrame:
    """class_id, n_covered: how many of the files (class_id, file) a test (file, text) is named after, or names as a word."""
    files = files.select("class_id", "file", stem(F.col("file")).alias("stem")).filter("stem <> ''").distinct()
    wanted = files.select("stem").distinct()
    named = tests.select(F.regexp_replace(stem(F.col("file")), "^test_|(_test|[.]test|[.]spec)$", "").alias("stem"))
    words = tests.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("stem"))
    tested = named.unionByName(words).join(wanted, "stem", "left_semi").distinct()
    return files.join(tested, "stem", "left_semi").groupBy("class_id").agg(F.count(F.lit(1)).alias("n_covered"))


def best(members: DataFrame, tests: DataFrame, k: int = MOST) -> DataFrame:
    """rank, class_id, n_copies, n_files, lines_saved, n_covered, score, label of the k best classes of rows (class_id, file, text)."""
    members = checkpoint(members)
    looked_up = possible(checkpoint(groups(members)), k)
    covered = coverage(members.select("class_id", "file").distinct().join(looked_up.select("class_id"), "class_id", "left_semi"), tests)
    full = looked_up.join(covered, "class_id", "left").withColumn("n_covered", F.coalesce("n_covered", F.lit(0)))
    full = full.withColumn("score", rounded(F.col("known") + 100 * F.col("n_covered") / F.col("n_files") * RISK))
    top = full.orderBy(F.desc("score"), "class_id").limit(k)
    label = F.when(F.lit(False), "")
    for least, name in LABELS:
        label = label.when(F.col("score") >= least, name)
    # k rows at most.
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "class_id"))
    return top.select(rank.alias("rank"), "class_id", "n_copies", "n_files", "lines_saved", "n_covered", "score", label.otherwise("minimal").alias("label"))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _code(spark, sf_dir).select("id", "file", "text")
    classes = clones.clone_classes(code.select("id", "text")).select("id", "class_id")
    is_test = F.col("file").rlike(TEST_FILE)
    # Texts are estimated at the size of the table that they are made from: without the hint the driver gathers them to broadcast.
    return best(code.filter(~is_test).join(classes.hint("shuffle_merge"), "id").select("class_id", "file", "text"), code.filter(is_test).select("file", "text"))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")
    return ranked(events, [F.desc("value"), F.col("event_id")]).select("event_id", F.col("rank").alias("rank_"))


FRAMES = {"e01_rank_by_score": _ranked, "j20_best_candidates": _best}

_LABELLED = " ".join(f"when score >= {least} then '{name}'" for least, name in LABELS)
FRAME_ORACLES = {
    "e01_rank_by_score": "select event_id, row_number() over (order by value desc nulls last, event_id) as rank_ from events",
    # Every class is looked up in the tests.
    "j20_best_candidates": dialect.duck_sql(f"""with found as ({clones.FRAME_ORACLES["j19_clone_classes"]}),
own as (select class_id, file, len(string_split(text, chr(10))) as lines, len(regexp_extract_all(text, '{BRANCHES}')) as branches, regexp_extract(file, '([^/]*)[.][^./]*$', 1) as stem
  from code_ c join found on id = construct_id where not matches_(file, '{TEST_FILE}')),
tests as (select distinct regexp_extract(file, 'test_([^/]*)[.][^./]*$', 1) as stem from code_ c where matches_(file, '{TEST_FILE}')
  union select unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) from code_ c where matches_(file, '{TEST_FILE}')),
g as (select class_id, count(*) as n_copies, count(distinct file) as n_files, sum(lines) - max(lines) as lines_saved, min(branches) as branches,
  count(distinct file) filter (where stem in (select stem from tests)) as n_covered from own group by class_id having count(*) > 1),
s as (select *, round(least(lines_saved / {LINES_A_POINT}, 100) * {SAVINGS} + greatest(0, 100 - branches * {BRANCH}) * {COMPLEXITY} + greatest(0, 100 - (n_copies * {COPY} + n_files * {FILE})) * {EFFORT}
  + 100 * n_covered / n_files * {RISK} + 1e-9, 2) as score from g)
select row_number() over (order by score desc, class_id) as rank, class_id, n_copies, n_files, lines_saved, n_covered, score, case {_LABELLED} else 'minimal' end as label from s order by score desc, class_id limit {MOST}"""),
}
