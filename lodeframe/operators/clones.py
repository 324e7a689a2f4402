"""Classes of similar code: an exact join of shingle sets, merged to classes.

Equal texts are one node from the start. Nodes are linked by the exact Jaccard similarity of their
shingles of three tokens, which ``setjoin`` finds for all pairs. Links are merged to classes.

Null texts and those without tokens are alike only to equal ones that are not null.
Repeated ids count once, as the row with the least text. Empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.operators import setjoin
from lodeframe.operators.graph import components
from lodeframe.operators.search import _code
from lodeframe.plans import dialect
from lodeframe.plans.skew import lookup_join
from lodeframe.session import checkpoint, spread

SIMILARITY = 0.8


def links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, similarity of the linked pairs of nodes (node, text) with different texts."""
    return setjoin.similar_sets(_sets(nodes), similarity)


def _sets(nodes: DataFrame) -> DataFrame:
    return checkpoint(spread(nodes).select("node", setjoin.token_shingles(F.col("text")).alias("items")))


def clone_classes(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """id, class_id (the least id of the class), n_copies (equal texts), n_links (to different texts) of rows (id, text)."""
    own = F.when(F.col("text").isNotNull(), F.sha2("text", 256)).otherwise(F.concat(F.lit("null "), F.col("id").cast("string")))
    rows = checkpoint(rows.groupBy("id").agg(F.min("text").alias("text")).withColumn("digest", own))
    total = rows.count()
    # The text itself is not carried through the count of copies.
    groups = checkpoint(rows.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n_copies")))
    nodes = checkpoint(rows.join(groups.select(F.col("node").alias("id")), "id", "left_semi").select(F.col("id").alias("node"), "text"))
    # Links grow with the square of the copies of a template, so they are counted and not kept.
    degree, edges = setjoin.link_counts(_sets(nodes), similarity)
    classes = components(edges)
    known = groups.join(classes, "node", "left").join(degree, "node", "left").select("digest", F.coalesce("class", "node").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return lookup_join(rows.select("id", "digest"), known.withColumn("weight", F.col("n_copies")), ["digest"], "weight", total).select("id", "class_id", "n_copies", "n_links")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clone_classes(_code(spark, sf_dir).select("id", "text"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verified links between class representatives: texts that are equal appear once."""
    code = _code(spark, sf_dir)
    return links(code.groupBy("text").agg(F.min("id").alias("node")).select("node", "text"))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the functions of each file in order of their ids."""
    return setjoin.anchor_clusters(_code(spark, sf_dir).select(F.col("file").alias("bucket"), "id", "text"), SIMILARITY)


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file, whether its functions, of which no two are candidates, are all compared."""
    code = checkpoint(_code(spark, sf_dir).select("id", F.col("file").alias("bucket"), "text"))
    tokens = F.size(F.regexp_extract_all("text", F.lit(setjoin.TOKEN), F.lit(0)))
    own = spread(code.select("id", "bucket", "text")).select(F.struct("bucket", "id").alias("node"), F.transform(setjoin.token_shingles(F.col("text")), lambda x: F.xxhash64("bucket", x)).alias("items"))
    pairs = setjoin.similar_sets(checkpoint(own), SIMILARITY).select(F.col("a.bucket").alias("bucket"))
    return setjoin.compare_all(code.select("bucket", tokens.alias("tokens")), pairs)


FRAMES = {"j06_similar_pairs": _links, "j19_clone_classes": _classes, "e02_anchor_clusters": _anchors, "c15_fallback_gate": _gate}

#: All pairs, by the strings of their shingles: nothing is hashed, ordered or left out.
_SETS = f"""
tokens as (select {{key}} as node, {{bucket}} as bucket, min(construct_id) as id, count(*) as n_copies, regexp_extract_all(text, '{setjoin.TOKEN}') as t from code_ c group by {{group}}),
sets as (select *, list_distinct(list_transform(range(1, greatest(len(t) - {setjoin.SHINGLE} + 1, 1) + 1), lambda i: array_to_string(t[i:i + {setjoin.SHINGLE} - 1], ' '))) as s from tokens where len(t) > 0),
shingles as (select node, bucket, len(s) as size, unnest(s) as shingle from sets),
met as (select x.node as a, y.node as b, any_value(x.size) as m, any_value(y.size) as n, count(*) as shared from shingles x join shingles y on x.shingle = y.shingle and x.bucket = y.bucket and x.node < y.node group by 1, 2),
linked as (select a, b, shared / (m + n - shared) as similarity from met where shared / (m + n - shared) >= {SIMILARITY})
"""
_BY_TEXT = _SETS.format(key="min(construct_id)", bucket="0", group="text")
_BY_ITEM = _SETS.format(key="construct_id", bucket="file", group="construct_id, file, text")
FRAME_ORACLES = {
    "j06_similar_pairs": dialect.duck_sql(f"with {_BY_TEXT} select a, b, similarity from linked"),
    "j19_clone_classes": dialect.duck_sql(f"""with recursive {_BY_TEXT},
both_ways as (select a, b from linked union all select b, a from linked),
reached as (select node, node as other from tokens union select r.node, b.b from reached r join both_ways b on b.a = r.other),
classes as (select node, min(other) as class_id from reached group by node),
degree as (select a as node, count(*) as n_links from both_ways group by a),
first as (select text, min(construct_id) as node from code_ c group by text)
select c.construct_id as id, class_id, n_copies, coalesce(n_links, 0) as n_links from code_ c join first using (text) join classes using (node) join tokens using (node) left join degree using (node)"""),
    "c15_fallback_gate": dialect.duck_sql(f"""with {_BY_ITEM},
sizes as (select bucket, count(*) as n_items, count(*) filter (where len(t) < {setjoin.FEW_TOKENS}) as n_small from tokens group by bucket),
pairs as (select bucket, count(*) as n_candidates from linked join tokens on a = node group by bucket)
select bucket, n_items, n_small, coalesce(n_candidates, 0) as n_candidates, coalesce(n_candidates, 0) = 0 and n_items <= {setjoin.MOST_ITEMS} and (n_small > 0 or n_items <= {setjoin.FEW_ITEMS}) as compare_all from sizes left join pairs using (bucket)"""),
}
