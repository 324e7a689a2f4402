"""Walks of JSON texts: parse or null, and the references at any depth with their paths.

Texts become variants, which Spark keeps in binary form, so that a walk opens only what it goes through. The walk goes
down level by level: each round opens the objects and arrays of the last one into rows, so that a document of a
million values is rows of many tasks, and rounds are as many as the deepest nesting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.plans import dialect
from lodeframe.session import checkpoint

#: Fixed value: the key of an entity's name.
ID = "@id"


def parse_or_null(text: Column) -> Column:
    """The variant of a JSON text, white space around it aside; null for what is null, empty or malformed."""
    return F.try_parse_json(F.trim(F.translate(text, "\t\r\n", "   ")))


def id_references(texts: DataFrame) -> DataFrame:
    """doc, path, id of every reference in rows (doc, text): an object that has nothing but ``@id``, and where it is.

    Paths are keys joined by dots, with places of arrays in brackets; a text that is a reference itself has an empty path.
    What ``@id`` names in an object with other keys is no reference. Ids are given as text, whatever their type.
    Malformed texts have none. Rows of one doc are walked each.
    """
    parsed = texts.select("doc", F.lit("").alias("path"), parse_or_null(F.col("text")).alias("value")).filter("value is not null")
    front, parts = checkpoint(parsed), []
    while not front.isEmpty():
        # One level of a value, whatever is below it: a map of an object, a list of an array, neither of anything else.
        opened = front.select("doc", "path", F.try_variant_get("value", "$", "map<string, variant>").alias("m"), F.try_variant_get("value", "$", "array<variant>").alias("a"))
        alone = F.coalesce((F.size("m") == 1) & F.array_contains(F.map_keys("m"), ID), F.lit(False))
        dot = F.when(F.col("path") == "", "").otherwise(".")
        keys = F.transform(F.map_entries("m"), lambda e: F.struct(F.concat("path", dot, e["key"]).alias("path"), e["value"].alias("value"), (e["key"] == ID).alias("own")))
        items = F.transform("a", lambda x, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("value"), F.lit(False).alias("own")))
        level = checkpoint(opened.select("doc", F.col("path").alias("at"), alone.alias("alone"), F.explode(F.coalesce(keys, items)).alias("x")))
        parts.append(level.filter("alone").select("doc", F.col("at").alias("path"), F.col("x.value").cast("string").alias("id")))
        front = level.filter("not alone and not x.own").select("doc", "x.path", "x.value")
    if not parts:
        return front.select("doc", "path", F.lit(None).cast("string").alias("id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Sites as JSON: nested entities that refer to others, some texts cut off, one in a list, one deep in lists.
SITES = """
select p_partkey as doc, case when p_partkey % 19 = 0 then substr(j, 1, length(j) - 3) when p_partkey % 23 = 0 then ' [' || j || ', 7, null] ' when p_partkey % 29 = 0 then '' else j end as text
from (select p_partkey, '{"@id": "#p' || cast(p_partkey as string_) || '", "name": "' || p_name || '", "size": ' || cast(p_size as string_)
  || ', "author": {"@id": "#p' || cast(p_partkey + 7 as string_) || '"}, "parts": [{"@id": "#a"}, "text", {"@type": "Part", "of": {"@id": "#p' || cast(p_size as string_) || '"}}, [[{"@id": "#deep"}]]]'
  || case when p_partkey % 5 = 0 then ', "owner": {"@id": "#o", "name": "x"}, "empty": {}, "none": []' else '' end
  || ', "more": ' || repeat('{"in": [1, ', cast(p_size % 4 as int)) || '{"@id": "#m"}' || repeat(']}', cast(p_size % 4 as int)) || '}' as j from part) t
"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run(spark, sf_dir, SITES)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_references(_sites(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, valid, name: what parses, and what a path finds in it."""
    value = parse_or_null(F.col("text"))
    return _sites(spark, sf_dir).select("doc", value.isNotNull().alias("valid"), F.try_variant_get(value, "$.name", "string").alias("name"))


FRAMES = {"i21_id_references": references, "i22_parse_or_null": parsed}
FRAME_ORACLES = {
    "i21_id_references": f"""with sites as ({dialect.duck_sql(SITES)}),
tree as (select doc, t.* from (select * from sites where json_valid(text)) s, lateral (select * from json_tree(s.text)) t)
select doc, regexp_replace(regexp_replace(substr(fullkey, 2), '"', '', 'g'), '^[.]', '') as path, json_extract_string(value, '$."{ID}"') as id
from tree where type = 'OBJECT' and json_keys(value) = ['{ID}']""",
    "i22_parse_or_null": f"with sites as ({dialect.duck_sql(SITES)}) select doc, json_valid(text) as valid, case when json_valid(text) then json_extract_string(text, '$.name') end as name from sites",
}
