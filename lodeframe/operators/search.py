"""Search, clones and fixes over code: patterns, signatures and their index, trees, edits."""

from __future__ import annotations

import difflib
import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import syntax
from lodeframe.plans import dialect
from lodeframe.session import ship, spread, written

#: Permutations, tokens of a shingle of code, tokens below which texts are compared directly.
PERMUTATIONS, SHINGLE, FEW_TOKENS = 128, 3, 15
#: Bands of the index. Rows of a band: 4, so that pairs of 0.6 or more are nearly all found.
BANDS = 32
#: Numbers of a sketch.
SKETCH = PERMUTATIONS // 32
TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]")

_RANDOM = np.random.default_rng(1)
_A = _RANDOM.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def shingles(text: str) -> set[str]:
    tokens = TOKEN.findall(text)
    return {" ".join(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))} if tokens else set()


def _signature(text: str | None) -> list[int]:
    found = shingles(text or "")
    if not found:
        return []
    hashed = np.array([xxhash.xxh3_64_intdigest(s) for s in found], np.uint64)
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    # Slices keep a long text's table of permutations small.
    for at in range(0, len(hashed), 4096):
        mixed = hashed[at : at + 4096, None] * _A + _B
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(31))).min(axis=0))
    return least.view(np.int64).tolist()


@F.pandas_udf(T.ArrayType(T.LongType()))
def signature(text: pd.Series) -> pd.Series:
    """The least hash of a text's shingles under each permutation; empty without tokens."""
    return pd.Series([_signature(t) for t in text], dtype=object)


@F.pandas_udf(T.DoubleType())
def token_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Estimated Jaccard similarity of two texts; short ones are matched token by token."""

    def of(x: str | None, y: str | None) -> float:
        if not x or not y:
            return 0.0
        s, t = TOKEN.findall(x), TOKEN.findall(y)
        if min(len(s), len(t)) < FEW_TOKENS:
            return difflib.SequenceMatcher(None, s, t).ratio()
        return float(np.mean(np.array(_signature(x)) == np.array(_signature(y))))

    return pd.Series([of(x, y) for x, y in zip(a, b)], dtype="float64")


def bands(sig: Column) -> Column:
    """A hash of each band of a signature, with the band's number."""
    rows = PERMUTATIONS // BANDS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(i, F.slice(sig, i * rows + 1, rows)).alias("hash")))


def sketch(sig: Column) -> list[Column]:
    """Two bits of each of a signature's hashes, 32 to a number."""
    return [F.aggregate(F.slice(sig, 32 * i + 1, 32), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 2).bitwiseOR(x.bitwiseAND(F.lit(3)))).alias(f"s{i}") for i in range(SKETCH)]


def _differing() -> Column:
    """How many of the two bits differ between the sketches s and q: in so many places at least the signatures do."""
    apart = [F.col(f"s{i}").bitwiseXOR(F.col(f"q{i}")) for i in range(SKETCH)]
    return sum((F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for x in apart), F.lit(0))


def index(rows: DataFrame, sketched: bool = False) -> DataFrame:
    """id, band, hash for each band of each row (id, sig) that has tokens; with its sketch if asked for."""
    own = [f"s{i}" for i in range(SKETCH)] if sketched else []
    found = rows.filter(F.size("sig") > 0).select("id", "sig", *sketch(F.col("sig"))) if sketched else rows.filter(F.size("sig") > 0)
    return found.select("id", *own, F.explode(bands(F.col("sig"))).alias("x")).select("id", "x.band", "x.hash", *own)


def similar_to(queries: DataFrame, rows: DataFrame, similarity: float = 0.8) -> DataFrame:
    """query_id, id, similarity of the ``rows`` (id, text) that are like a query (id, text), by the index.

    Candidates share a band and are confirmed by their signatures; those whose sketches differ in more places than the
    similarity allows are none. A row is never its own find. Rows without tokens find nothing and are not found.
    """
    # Signatures are made once; what the probes meet are two bits of each place of them.
    signed = written(spread(rows.select("id", "text")).select("id", signature("text").alias("sig")))
    asked = written(queries.select(F.col("id").alias("query_id"), signature("text").alias("query_sig")))
    probes = index(asked.select(F.col("query_id").alias("id"), F.col("query_sig").alias("sig")), True).withColumnsRenamed({"id": "query_id", **{f"s{i}": f"q{i}" for i in range(SKETCH)}})
    met = index(signed, True).join(probes.hint("shuffle_merge"), ["band", "hash"])
    most = PERMUTATIONS - math.ceil(similarity * PERMUTATIONS - 1e-9)
    pairs = met.filter((F.col("id") != F.col("query_id")) & (_differing() <= most)).select("query_id", "id").distinct()
    agree = F.aggregate(F.zip_with("sig", "query_sig", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / PERMUTATIONS
    found = pairs.join(signed.dropDuplicates(["id"]).hint("shuffle_merge"), "id").join(asked.dropDuplicates(["query_id"]).hint("shuffle_merge"), "query_id")
    return found.select("query_id", "id", agree.alias("similarity")).filter(F.col("similarity") >= similarity)


def find_code(lines: DataFrame, pattern: str) -> DataFrame:
    """The columns of ``lines`` (with ``line``), column, text and variables (a map) where a pattern first matches."""
    expression, names = syntax.pattern_regex(pattern)
    text = F.regexp_extract("line", expression, 0)
    groups = F.map_from_arrays(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.array(*[F.regexp_extract("line", expression, i + 1) for i in range(len(names))]).cast("array<string>"))
    return lines.filter(F.col("line").rlike(expression)).select("*", (F.position(text, F.col("line")) - 1).alias("column"), text.alias("text"), groups.alias("variables"))


def rewrite_code(lines: DataFrame, pattern: str, fix: str) -> DataFrame:
    """The lines that a pattern matches, with ``fixed``: each match replaced by ``fix``, whose variables are those of the pattern."""
    expression, names = syntax.pattern_regex(pattern)
    template = re.sub(r"([\\\\])", r"\\\\\1", fix)
    for at, name in sorted(enumerate(names, 1), key=lambda x: -len(x[1])):
        template = template.replace(f"$$${name}", f"\0{at}\0").replace(f"${name}", f"\0{at}\0")
    template = re.sub("\0(\\d+)\0", r"${v\1}", template.replace("$", "\\$"))
    for at in range(1, len(names) + 1):
        template = template.replace(f"${{v{at}}}", f"${at}")
    return lines.filter(F.col("line").rlike(expression)).select("*", F.regexp_replace("line", expression, template).alias("fixed"))


def hybrid_similarity(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """id, similarity, method of pairs (id, a, b): those that are unlike by tokens stop there, others are compared by lines as well."""
    like = F.col("tokens") >= least
    first = pairs.select("id", "a", "b", token_similarity("a", "b").alias("tokens"))
    # One pass over the pairs: of those that are unlike the function gets a null, for which it does nothing.
    both = first.select("id", "tokens", syntax.line_similarity(F.when(like, F.col("a")), "b").alias("lines"))
    return both.select("id", F.when(like, 0.4 * F.col("tokens") + 0.6 * F.col("lines")).otherwise(F.col("tokens")).alias("similarity"), F.when(like, "hybrid").otherwise("minhash").alias("method"))


def apply_fixes(lines: DataFrame, fixes: DataFrame) -> DataFrame:
    """file, text after ``fixes`` (file, line_no, replacement) of whole ``lines`` (file, line_no, line).

    A null replacement removes the line. Lines keep their numbers until all are set, so
    that no edit moves another; of several fixes of a line the least text wins.
    """
    one = fixes.groupBy("file", "line_no").agg(F.min("replacement").alias("replacement"), F.lit(True).alias("fixed"))
    done = lines.join(one, ["file", "line_no"], "left").withColumn("line", F.when(F.col("fixed"), F.col("replacement")).otherwise(F.col("line")))
    # A group is one file, which a reader holds as one text anyway.
    ordered = F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("line_no", "line"))))
    return done.groupBy("file").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return dialect.run(spark, sf_dir, "select construct_id as id, file, lang, name, text from code_ c")


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text beside the one forty on."""
    code = _code(spark, sf_dir)
    # Texts are not for the driver to gather, however small the table that they are made from.
    return code.join(code.select((F.col("id") - 40).alias("id"), F.col("text").alias("other")).hint("shuffle_merge"), "id")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run(spark, sf_dir, "select construct_id as id, cast(construct_id as string) as file, line_no, line from code_lines_ c")


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _code(spark, sf_dir).select("id", "text")
    return similar_to(rows.filter("id % 100 = 0"), rows)


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return apply_fixes(lines, lines.filter("line like '%console.log%' or line like '% var %'").select("file", "line_no", F.when(F.col("line").contains("var"), F.regexp_replace("line", r"\bvar\b", "let")).alias("replacement")))


FRAMES = {
    "j01_signatures": lambda spark, sf: _code(spark, sf).select("id", signature("text").alias("sig")),
    "j02_token_similarity": lambda spark, sf: _neighbours(spark, sf).select("id", token_similarity("text", "other").alias("similarity")),
    "j04_band_index": lambda spark, sf: index(_code(spark, sf).select("id", signature("text").alias("sig"))),
    "c17_similar_search": _searched,
    "j08_line_similarity": lambda spark, sf: _neighbours(spark, sf).select("id", syntax.line_similarity("text", "other").alias("similarity")),
    "j12_line_edits": lambda spark, sf: _neighbours(spark, sf).select("id", F.explode(syntax.line_edits("text", "other")).alias("e")).select("id", "e.*"),
    "j14_unified_diff": lambda spark, sf: _neighbours(spark, sf).select("id", syntax.unified_diff("text", "other", "file").alias("diff")),
    "d33_edit_counts": lambda spark, sf: _neighbours(spark, sf).select(F.explode(syntax.line_edits("text", "other")["kind"]).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "l03_syntax": lambda spark, sf: _code(spark, sf).select("id", syntax.syntax_errors("text", "lang").alias("error")),
    "l04_syntax_summary": lambda spark, sf: _code(spark, sf).select("lang", syntax.syntax_errors("text", "lang").alias("error")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("invalid")),
    "l22_signatures": lambda spark, sf: _code(spark, sf).filter("lang = 'python'").select("id", F.explode(syntax.signatures("text")).alias("f")).select("id", "f.*"),
    "l30_surface": lambda spark, sf: _code(spark, sf).filter("lang = 'python'").select("id", syntax.python_surface("text").alias("surface")),
    "l36_syntax_tree": lambda spark, sf: _code(spark, sf).filter("lang = 'python'").select("id", F.explode(syntax.tree("text")).alias("t")).select("id", "t.*"),
    "b19_inside": lambda spark, sf: _code(spark, sf).filter("lang = 'python'").select("id", syntax.tree("text").alias("nodes")).select("id", F.explode(syntax.inside(F.col("nodes"), "Call", "For")).alias("t")).select("id", "t.*"),
    "l37_find_code": lambda spark, sf: find_code(_lines(spark, sf), "if $A > $B and $$$REST:").select("id", "line_no", "column", "text", F.col("variables")["A"].alias("a"), F.col("variables")["B"].alias("b")),
    "l08_fixes": _fixed,
    "j07_hybrid_similarity": lambda spark, sf: hybrid_similarity(_neighbours(spark, sf).select("id", F.col("text").alias("a"), F.col("other").alias("b"))),
    "j09_precise_similarity": lambda spark, sf: _neighbours(spark, sf).select("id", syntax.line_similarity(*[F.regexp_replace(c, r"(?m)^ {5,}", "    ") for c in ("text", "other")]).alias("similarity")),
    "k07_tree_depth": lambda spark, sf: _code(spark, sf).filter("lang = 'python'").select("id", F.explode(syntax.tree("text")).alias("t")).groupBy("id").agg(F.count(F.lit(1)).alias("nodes"), F.max("t.depth").alias("depth")),
    "l05_pattern_fix": lambda spark, sf: rewrite_code(_lines(spark, sf), "print($X)", "log.info($X)").select("id", "line_no", "fixed"),
    "i28_edit_statistics": lambda spark, sf: _neighbours(spark, sf).select("id", syntax.line_edits("text", "other").alias("e")).select("id", F.size("e").alias("edits"), F.aggregate("e", F.lit(0), lambda n, x: n + F.when(x["kind"] != "equal", x["old_end"] - x["old_start"] + x["new_end"] - x["new_start"]).otherwise(0)).alias("changed")),
}
FRAME_ORACLES = {
    "l05_pattern_fix": dialect.duck_sql(r"select construct_id as id, line_no, regexp_replace(line, r'print\s*\(([^\s,()]+)\)', r'log.info(\1)') as fixed from code_lines_ c where matches_(line, r'print\([^\s,()]+\)')"),
    "l37_find_code": dialect.duck_sql(r"select construct_id as id, line_no, position('if a >' in line) - 1 as column, regexp_extract(line, r'if a > [^\s,()]+ and .*:', 0) as text, 'a' as a, regexp_extract(line, r'if a > ([^\s,()]+) and', 1) as b from code_lines_ c where matches_(line, r'if a > [^\s,()]+ and .*:')"),
    "l08_fixes": "with l as (" + dialect.duck_sql("select construct_id, line_no, line from code_lines_ c") + r") select cast(construct_id as varchar) as file, string_agg(regexp_replace(line, '\bvar\b', 'let', 'g'), chr(10) order by line_no) as text from l where not (line like '%console.log%' and line not like '%var%') group by 1",
}
