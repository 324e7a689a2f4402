"""Imports, references and entity graphs: resolution, reachability, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.plans.skew import weighed_join
from lodeframe.session import checkpoint, few, settle

_FOLDER = "regexp_replace(source, '/[^/]*$', '')"
_PARENT = "regexp_replace(source, '/[^/]*/[^/]*$', '')"
_AS_PATH = "replace(module, '.', '/')"
_BASE = f"case when level = 2 or module like '../%' then {_PARENT} else {_FOLDER} end"
_SCRIPT = "regexp_replace(module, '^[.]+/', '')"


def _resolved(candidates: str) -> str:
    """The first candidate path, by priority, that is a file."""
    return f"select import_id, source, target from (select c.import_id, c.source, c.target, row_number() over (partition by c.import_id order by c.priority) as r from ({candidates}) c join (select distinct file from code_ f) f on c.target = f.file) t where r = 1"


def _tries(where: str, paths: list[str]) -> str:
    return " union all ".join(f"select import_id, source, {p} as target, {i} as priority from imports_ i{i} where {where}" for i, p in enumerate(paths))


_ABSOLUTE = _tries("level = 0", [f"{_AS_PATH} || '/__init__.py'", f"{_AS_PATH} || '.py'", f"'src/' || {_AS_PATH} || '/__init__.py'", f"'src/' || {_AS_PATH} || '.py'"])
_RELATIVE = _tries("level > 0", [f"{_BASE} || '/' || {_AS_PATH} || '.py'", f"{_BASE} || '/' || {_AS_PATH} || '/__init__.py'"])
_PATHS = _tries("level = -1 and module like '.%'", [f"{_BASE} || '/' || {_SCRIPT} || {suffix}" for suffix in ("''", "'.ts'", "'.tsx'", "'.js'", "'.jsx'", "'/index.ts'", "'/index.js'")] + [f"{_BASE} || '/' || regexp_replace({_SCRIPT}, '[.]js$', '.ts')"])

_TYPES = "(select entity, site, type_a as type from entities_ a union all select entity, site, type_b from entities_ b where type_b is not null)"
# What is suggested when a site has one type and lacks another.
_SUGGEST = [("Organization", 1, "FAQPage", "high"), ("Organization", 1, "WebSite", "high"), ("WebPage", 2, "BreadcrumbList", "medium"), ("Service", 1, "Review", "critical"), ("BlogPosting", 1, "BreadcrumbList", "medium"), ("Product", 1, "Review", "critical")]
_RULES = " union all ".join(f"select '{a}' as has_type, {n} as least_count, '{b}' as suggest, '{p}' as priority" for a, n, b, p in _SUGGEST)

QUERIES = {
    "c02_import_edges": _resolved(f"{_ABSOLUTE} union all {_RELATIVE} union all {_PATHS}"),
    "c03_prefix_resolution": _resolved(_ABSOLUTE),
    "c04_relative_imports": _resolved(_RELATIVE),
    "c05_script_imports": _resolved(_PATHS),
    "c25_broken_references": "select e.id, e.ref from entities_ e left join (select id as known from entities_ k) k on e.ref = k.known where k.known is null",
    "c28_relationships": "select e.id, e.ref, k.label as ref_label from entities_ e left join (select id as known, label from entities_ k) k on e.ref = k.known",
    "d30_entity_types": f"select type, count(*) as n from {_TYPES} t group by type",
    "b28_suggestions": f"select h.site, r.suggest, r.priority, max(h.n) as n from (select site, type, count(*) as n from {_TYPES} t group by site, type) h join ({_RULES}) r on h.type = r.has_type and h.n >= r.least_count left join (select distinct site, type from {_TYPES} u) u on u.site = h.site and u.type = r.suggest where u.site is null group by h.site, r.suggest, r.priority",
    "l47_missing_properties": "select id, array_text_(array_filter_(array(case when label is null then 'name' end, case when type_b is null and type_a = 'Product' then 'offers' end), x -> x is not null), ',') as missing from entities_ e",
    "k05_entity_graph": "select id, label, case when type_b is null then type_a else type_a || ',' || type_b end as types, '{\"@id\": \"' || ref || '\"}' as link from entities_ e",
}


def reachable(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """node, depth of every node that can be reached from the ``entries`` (node) along ``edges`` (source, target).

    Each round joins only the frontier, and writes only what it finds: all rounds together
    write each node once. Cycles end, as a node is entered once. Null ends lead nowhere;
    repeated edges and entries count once.
    """
    edges = checkpoint(edges.select("source", "target").dropna().distinct())
    frontier = checkpoint(entries.select("node").dropna().distinct().withColumn("depth", F.lit(0)))
    seen, depth = frontier, 0
    while not frontier.isEmpty():
        depth += 1
        found = edges.join(frontier, edges["source"] == frontier["node"], "left_semi").select(F.col("target").alias("node")).distinct()
        frontier = checkpoint(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:
            # The parts of so many rounds are put together, so that the plan stays small.
            seen = checkpoint(seen)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """node, class: the least node that each end of ``edges`` (source, target) is connected to.

    Every node of a round points to its least neighbour, if that is less than itself; the
    pointers are followed to their ends, and the edges move to the ends. At least half of the
    nodes that still have edges go in a round, and edges within one end go with them, so all
    rounds together do little more than the first. A node that many point to is joined by
    broadcast. Nothing is collected. Null ends are dropped; loops and repeats do not matter.
    Rounds have no more tasks than their rows are work for: each task leaves files on disk, in every step of a round.
    """
    ends = settle(edges.select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v")).filter("source is not null and target is not null").distinct())
    label, size = ends.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("class", F.col("node")), ends.count()
    label, ends = few(label, 2 * size), few(ends.filter("u <> v"), size)
    left = ends.count()
    while left:
        both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = checkpoint(few(both.groupBy(F.col("u").alias("from")).agg(F.least(F.min("v"), F.col("u")).alias("to")), 2 * left))
        while True:
            beyond = to.select(F.col("from").alias("to"), F.col("to").alias("beyond"))
            step = weighed_join(to, beyond, ["to"], 2 * left).select("from", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved"))
            step = settle(few(step, 2 * left))
            to = step.select("from", "to")
            if step.filter("moved").isEmpty():
                break
        label = weighed_join(label, to.withColumnRenamed("from", "class"), ["class"], 2 * size).select("node", F.coalesce("to", "class").alias("class"))
        label = settle(few(label, 2 * size))
        moved = weighed_join(ends, to.select(F.col("from").alias("u"), F.col("to").alias("p")), ["u"], left)
        moved = weighed_join(moved, to.select(F.col("from").alias("v"), F.col("to").alias("q")), ["v"], left)
        ends = settle(few(moved.filter("p <> q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), left))
        left = ends.count()
    return label


_EDGES = "select p_partkey as source, p_partkey * 2 as target from part where p_size % 5 <> 0 union all select p_partkey, p_partkey * 3 + 1 from part where p_size % 3 <> 0"
_LINKS = "select p_partkey as source, p_partkey + p_size as target from part where p_size % 4 = 0"


def _part(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part")
    return spark.sql(text)


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reachable(_part(spark, sf_dir, _EDGES), spark.range(1, 3).withColumnRenamed("id", "node"))


def group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_part(spark, sf_dir, _LINKS))


FRAMES = {"k03_reachability": reachability, "k04_group_merge": group_merge}
FRAME_ORACLES = {
    "k03_reachability": f"with recursive e as ({_EDGES}), r as (select x as node, 0 as depth from (values (1), (2)) v(x) union select e.target, r.depth + 1 from r join e on e.source = r.node) select node, min(depth) as depth from r group by node",
    "k04_group_merge": f"with recursive e as (select source as a, target as b from ({_LINKS}) l union select target, source from ({_LINKS}) m), r as (select a as node, a as other from e union select r.node, e.b from r join e on e.a = r.other) select node, min(other) as class from r group by node",
}
