"""Files as tables: project files, lines, match records, logs, snapshots."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that no scan enters, and the file names of each language.
SKIPPED = ["node_modules", "venv", ".venv", "build", "dist", "__pycache__"]
EXTENSIONS = {"python": [".py", ".pyi"], "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs"], "java": [".java"], "rust": [".rs"], "go": [".go"], "html": [".html", ".htm"], "markdown": [".md", ".mdx"], "yaml": [".yml", ".yaml"], "json": [".json"]}

MATCH = "text string, file string, range struct<start: struct<line: int, column: int>, end: struct<line: int, column: int>>, metaVariables string"


def glob_pattern(glob: str) -> str:
    """A pattern for a path below the root: ``**/`` is any folders, ``*`` all but a slash."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + glob[i] if glob[i] in ".+()[]{}^$|\\" else glob[i]), i + 1
    return f"^{out}$"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def files(spark: SparkSession, root: str, language: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = 0, globs: dict[str, list[str]] | None = None) -> DataFrame:
    """file (below the root), length, modified, content of the files of a project.

    Hidden and ``SKIPPED`` folders and hidden files are left out. ``language`` keeps its
    file names, those of ``globs`` (a language's own) as well. ``max_bytes`` above 0 keeps
    files up to it; the path and the size are tested before any content is read. Of empty
    files, which Spark's sources pass over, the time is null.
    """
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    # The listing has the empty files; it is the one that the driver has made for the scan.
    listed = spark.createDataFrame([(unquote(x).split(base + "/", 1)[-1],) for x in found.inputFiles()], "below string")
    empty = listed.join(found.select(F.substring_index("path", base + "/", -1).alias("below")), "below", "left_anti")
    found = found.unionByName(empty.select(F.concat(F.lit(base + "/"), "below").alias("path"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")), allowMissingColumns=True)
    # The path is a URI whose part before the root varies with the file system.
    below = F.substring_index(F.col("path"), base + "/", -1)
    keep = ~below.rlike(r"(^|/)\.") & ~below.rlike(f"(^|/)({'|'.join(x.replace('.', chr(92) + '.') for x in SKIPPED)})/")
    if language:
        keep &= _any([below.endswith(x) for x in EXTENSIONS.get(language, [])] + [below.rlike(glob_pattern(g)) for g in (globs or {}).get(language, [])])
    if include:
        keep &= _any([below.rlike(glob_pattern(g)) for g in include])
    if exclude:
        keep &= ~_any([below.rlike(glob_pattern(g)) for g in exclude])
    if max_bytes > 0:
        keep &= F.col("length") <= max_bytes
    return found.filter(keep).select(below.alias("file"), "length", F.col("modificationTime").alias("modified"), "content")


def skipped_files(spark: SparkSession, root: str, max_bytes: int, **options) -> DataFrame:
    """The files that the bound on size leaves out; none without a bound."""
    found = files(spark, root, **options).drop("content")
    return found.filter(F.col("length") > max_bytes if max_bytes > 0 else F.lit(False))


def lines(found: DataFrame) -> DataFrame:
    """file, line_no (from 1), line of files with ``content``."""
    return found.select("file", F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("at", "line")).select("file", (F.col("at") + 1).alias("line_no"), "line")


def statistics(found: DataFrame, max_bytes: int = 1_048_576) -> DataFrame:
    """file, length, n_lines of files up to a size."""
    return found.filter(F.col("length") <= max_bytes).select("file", "length", F.size(F.split(F.col("content").cast("string"), "\n")).alias("n_lines"))


def matches(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Match records from lines of JSON; bad lines are skipped. A limit stops the scan early."""
    found = spark.read.text(path).select(F.from_json("value", MATCH, {"mode": "PERMISSIVE"}).alias("m")).filter("m.file is not null").select("m.*")
    return found.limit(limit) if limit > 0 else found


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log written with ``%h|%H|%an|%ae|%aI|%s|%b---COMMIT---``."""
    part = F.split(F.trim(F.regexp_replace("value", r"^\s+", "")), r"\|", 7)
    names = ["short", "hash", "author", "email", "date", "subject", "body"]
    rows = spark.read.text(path, lineSep="---COMMIT---").filter(F.size(F.split("value", r"\|", 7)) >= 6)
    return rows.select(*[F.coalesce(F.get(part, i), F.lit("")).alias(n) for i, n in enumerate(names)]).withColumn("date", F.expr("try_to_timestamp(date)"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """The nodes of a linked-data file: id, types, label, and the rest as it is."""
    schema = "`@graph` array<string>"
    nodes = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["@graph"]).alias("node"))
    kind = F.get_json_object("node", "$['@type']")
    return nodes.select(F.get_json_object("node", "$['@id']").alias("id"), F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind)).alias("types"), F.get_json_object("node", "$['rdfs:label']").alias("label"), "node")


def front_matter(found: DataFrame) -> DataFrame:
    """file, key, value of the plain ``key: value`` lines between the leading dashes."""
    head = F.regexp_extract(F.col("content").cast("string"), r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    rows = found.select("file", F.explode(F.split(head, r"\r?\n")).alias("line")).filter(F.col("line").rlike(r"^[A-Za-z_@][\w@-]*:"))
    return rows.select("file", F.regexp_extract("line", r"^([^:]+):", 1).alias("key"), F.regexp_replace(F.regexp_extract("line", r"^[^:]+:\s*(.*)$", 1), "^[\"']|[\"']$", "").alias("value"))


def append_log(rows: DataFrame, path: str) -> None:
    """Add usage rows, a folder for each day so that look-backs read only theirs."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def recent_logs(spark: SparkSession, path: str, limit: int = 100, tool: str | None = None, success: bool | None = None) -> DataFrame:
    """The newest rows of the log; the filters reach the scan, the limit is a top-k."""
    found = spark.read.parquet(path)
    if tool is not None:
        found = found.filter(F.col("tool") == tool)
    if success is not None:
        found = found.filter(F.col("success") == success)
    return found.orderBy(F.desc("ts"), "event_id").limit(limit)


def store_run(run: DataFrame, functions: DataFrame, path: str) -> None:
    """A run and its functions; the run is written last, so that functions without one are from a broken write."""
    functions.write.mode("append").parquet(f"{path}/function_metrics")
    run.write.mode("append").parquet(f"{path}/analysis_runs")


def new_projects(projects: DataFrame, known: DataFrame) -> DataFrame:
    """The projects that are not yet known, each once."""
    return projects.dropDuplicates(["path"]).join(known.select("path"), "path", "left_anti")


def save_snapshot(found: DataFrame, path: str, snapshot: str) -> None:
    """Keep files (file, content) with a digest as one partition; the same name replaces it."""
    found.select("file", "content", F.sha2("content", 256).alias("digest")).write.mode("overwrite").parquet(f"{path}/snapshot={snapshot}")


def restore_snapshot(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    return spark.read.parquet(f"{path}/snapshot={snapshot}").select("file", "content")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """snapshot, files, bytes, newest first by name."""
    return spark.read.parquet(path).groupBy("snapshot").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).alias("bytes")).orderBy(F.desc("snapshot"))


def intact(spark: SparkSession, path: str, snapshot: str) -> DataFrame:
    """file, intact: whether the kept content still has its digest."""
    return spark.read.parquet(f"{path}/snapshot={snapshot}").select("file", (F.sha2("content", 256) == F.col("digest")).alias("intact"))
