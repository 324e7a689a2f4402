"""One query text for two engines.

Queries are written in Spark SQL. What an engine says in its own way is written as a
name that ends in an underscore and is replaced for each: array functions, patterns, and
the derived tables ``code_`` (a code corpus made from ``part``), ``lines_`` (the lines of the documents)
and ``code_lines_`` (those of the corpus).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The code corpus: one function for each part, its shape decided by the key.
CODE = """
select p_partkey as construct_id,
  'src/' || case when p_partkey % 9 = 0 then 'tests/test_' when p_partkey % 7 = 0 then 'node_modules/' else 'app/' end || 'm' || cast(p_partkey % 40 as string_) || case when p_partkey % 3 = 0 then '.ts' else '.py' end as file,
  case when p_partkey % 3 = 0 then 'typescript' else 'python' end as lang,
  case when p_partkey % 13 = 0 then '__init__' when p_partkey % 8 = 0 then 'to_' || p_brand else 'fn_' || cast(p_partkey % 60 as string_) end as name,
  cast(1 + p_partkey % 50 as int) as start_line,
  'def fn_' || cast(p_partkey % 60 as string_) || '(a, b=2' || repeat(', p', cast(p_partkey % 7 as int)) || '):' || chr(10)
  || '    # TODO check ' || p_brand || chr(10)
  || '    if a > ' || cast(p_size as string_) || ' and b or a < 7:' || chr(10)
  || '        for i in range(' || cast(p_size as string_) || '):' || chr(10)
  || case when p_partkey % 4 = 0 then '            while b:' || chr(10) || '                print(i)' || chr(10) else '            print(i)' || chr(10) end
  || case when p_partkey % 5 = 0 then '    eval(a)' || chr(10) else '' end
  || case when p_partkey % 11 = 0 then '    password = "hunter' || cast(p_partkey as string_) || '222"' || chr(10) else '' end
  || case when p_partkey % 6 = 0 then '    var x = 1  // FIXME' || chr(10) || '    console.log(x)' || chr(10) else '' end
  || chr(10) || '    y = helper_' || cast(p_partkey % 17 as string_) || '(a) * 86400' || chr(10)
  || repeat('    y = y + 1' || chr(10), cast(p_size as int)) || '    return y' as text
from part
"""

#: Commits, in place of a repository's log: conventional subjects and others.
COMMITS = """
select o_orderkey as id, o_orderdate as made_at,
  case o_orderkey % 9 when 0 then 'feat(core): add column ' || cast(o_custkey as string_) || ' (#' || cast(o_custkey % 50 as string_) || ')'
    when 1 then 'fix: repair join, closes #7 and #' || cast(o_custkey % 9 as string_) when 2 then 'feat!: drop old reader'
    when 3 then 'docs(readme): say more' when 4 then 'Merge pull request #' || cast(o_orderkey as string_) || ' from branch'
    when 5 then 'refactor(plan)!: move rules' when 6 then 'update things' when 7 then 'perf:faster scan' else 'unknown(x): what' end as subject,
  case o_custkey % 6 when 0 then 'BREAKING CHANGE: names' when 1 then 'see PR ' || cast(o_custkey as string_) when 2 then 'BREAKING-CHANGE' else '' end as body
from orders
"""
#: Imports of the files of the code corpus: level 0 is absolute, more is relative, -1 a script's path.
IMPORTS = """
select p_partkey as import_id,
  'src/' || case when p_partkey % 9 = 0 then 'tests/test_' when p_partkey % 7 = 0 then 'node_modules/' else 'app/' end || 'm' || cast(p_partkey % 40 as string_) || case when p_partkey % 3 = 0 then '.ts' else '.py' end as source,
  case when p_partkey % 3 = 0 then -1 else cast(p_size % 3 as int) end as level,
  case when p_partkey % 3 = 0 then case p_size % 4 when 0 then './m' when 1 then '../app/m' when 2 then 'lib-' else './m' end || cast(p_size % 45 as string_) || case when p_size % 8 = 3 then '.js' else '' end
    else case p_size % 3 when 0 then 'app.m' when 1 then 'm' else 'app.m' end || cast(p_size % 45 as string_) end as module
from part
"""
#: Linked entities: an id, one or two types, a name and a reference to another id.
ENTITIES = """
select p_partkey as entity, p_size as site, 'https://example.com/#p' || cast(p_partkey as string_) as id,
  case p_partkey % 7 when 0 then 'Organization' when 1 then 'WebPage' when 2 then 'Product' when 3 then 'Service' when 4 then 'BlogPosting' when 5 then 'Review' else 'WebSite' end as type_a,
  case when p_partkey % 11 = 0 then 'FAQPage' when p_partkey % 13 = 0 then 'BreadcrumbList' end as type_b,
  case when p_partkey % 17 <> 0 then p_name end as label, 'https://example.com/#p' || cast(p_partkey + 7 as string_) as ref
from part
"""

_SPARK = {
    "commits_": f"({COMMITS})",
    "imports_": f"({IMPORTS})",
    "entities_": f"({ENTITIES})",
    "gathered_": "collect_list",
    "code_lines_": "(select construct_id, file, lang, name, start_line, pos + 1 as line_no, line from code_ lateral view posexplode(split(text, '\\n')) t as pos, line)",
    "lines_": "(select doc_id, pos + 1 as line_no, line from documents lateral view posexplode(split(text, '\\n')) t as pos, line)",
    "code_": f"({CODE})",
    "string_": "string",
    "array_length_": "size",
    "array_filter_": "filter",
    "array_map_": "transform",
    "array_text_": "array_join",
    "array_has_": "array_contains",
    "array_sorted_": "array_sort",
    "array_unique_": "array_distinct",
    "array_both_": "array_intersect",
    "matches_": "regexp_like",
    "numbers_": "sequence",
    "hash_": "md5",
    "slice_": "slice",
    "unnested_": "explode",
}
_DUCK = {
    "commits_": f"({COMMITS})",
    "imports_": f"({IMPORTS})",
    "entities_": f"({ENTITIES})",
    "gathered_": "list",
    "code_lines_": "(select construct_id, file, lang, name, start_line, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select *, string_split(text, chr(10)) as l from code_) as cl)",
    "lines_": "(select doc_id, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents) as dl)",
    "code_": f"({CODE})",
    "string_": "varchar",
    "array_length_": "len",
    "array_filter_": "list_filter",
    "array_map_": "list_transform",
    "array_text_": "array_to_string",
    "array_has_": "list_contains",
    "array_sorted_": "list_sort",
    "array_unique_": "list_distinct",
    "array_both_": "list_intersect",
    "matches_": "regexp_matches",
    "numbers_": "generate_series",
    "hash_": "md5",
    "slice_": "slice_from",
    "unnested_": "unnest",
}


#: The corpus for joins with itself. Spark estimates it at the size of ``part``, a hundredth of what its texts take, and would
#: broadcast it; the hint reaches the join above.
_GROWN = CODE.replace("select ", "select /*+ shuffle_merge(part) */ ", 1)


def _said(text: str, names: dict[str, str]) -> str:
    for name, says in names.items():
        text = re.sub(rf"(?<!\w){name}(?!\w)", lambda _: says, text)
    return text


def spark_sql(text: str, grown: bool = False) -> str:
    text = re.sub(r"(?<!\w)dot_\(([\w.]+), ([\w.]+)\)", r"aggregate(zip_with(\1, \2, (x, y) -> double(x) * double(y)), 0D, (p, q) -> p + q)", text)
    return _said(text, {**_SPARK, "code_": f"({_GROWN})"} if grown else _SPARK)


def duck_sql(text: str) -> str:
    """Lambdas get a keyword, extraction replaces all, raw strings lose their mark."""
    text = _said(text, _DUCK)
    text = re.sub(r"slice_from\((\w+), (\w+), (\d+)\)", r"\1[\2:\2 + \3 - 1]", text)
    text = re.sub(r"(?<!\w)dot_\(([\w.]+), ([\w.]+)\)", r"list_inner_product(\1::double[], \2::double[])", text)
    text = re.sub(r"(?<!\w)array\(", "list_value(", text)
    text = re.sub(r"(?<=[(,] )\((\w+), (\w+)\) -> ", r"lambda \1, \2: ", text)
    text = re.sub(r"(?<=[(,] )(\w+) -> ", r"lambda \1: ", text)
    text = _everywhere(text)
    return re.sub(r"(?<!\w)r'", "'", text)


def _everywhere(text: str) -> str:
    """Every regexp_replace with the option that replaces all matches."""
    name, at = "regexp_replace(", 0
    while (at := text.find(name, at)) >= 0:
        at += len(name)
        depth, quoted, end = 1, False, at
        while depth:
            c = text[end]
            quoted ^= c == "'"
            depth += 0 if quoted else (c == "(") - (c == ")")
            end += 1
        text = f"{text[: end - 1]}, 'g'{text[end - 1 :]}"
    return text


def run(spark: SparkSession, sf_dir: str, text: str, grown: bool = False) -> DataFrame:
    """The query over the tables of a folder; only the tables that it names are opened. With ``grown`` the code corpus is never broadcast."""
    said = spark_sql(text, grown)
    for name in TABLES:
        if re.search(rf"\b(?:from|join)\s+{name}\b", said):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(said)
