"""Metrics, rules and rewrites of code and text, on the generated code corpus and the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.plans import dialect

#: A row for each call of a function's text; what a definition has before its brackets is none.
_CALLS = "(select construct_id, file, unnested_(regexp_extract_all(regexp_replace(text, r'\\b(def|function)\\s+\\w+', ''), r'([A-Za-z_]\\w*)[(]', 1)) as callee from code_ t)"
_KEY = "(if |elif |for |while |except |with |case )"

QUERIES = {
    "a03_skip_directories": "select construct_id, file from code_ c where not matches_(file, '(^|/)(node_modules|venv|build|dist|[.][^/]*)/')",
    "a04_file_predicate": "select construct_id, length(text) as size from code_ c where matches_(file, '[.](py|ts)$') and length(text) < 1000",
    "a05_language_extensions": "select c.construct_id, e.ext from code_ c join (select 'python' as lang, '.py' as ext union all select 'typescript', '.ts' union all select 'typescript', '.tsx') e on c.lang = e.lang",
    "a13_file_stats": "select construct_id, length(text) as bytes, array_length_(regexp_extract_all(text, '\\n', 0)) + 1 as n_lines from code_ c where length(text) <= 1048576",
    "a27_rule_catalogue": "select id, severity from (select 'no-var' as id, 'typescript' as lang, 'warning' as severity, 'style' as category union all select 'no-eval-exec', 'python', 'error', 'security' union all select 'no-print-production', 'python', 'warning', 'style' union all select 'no-bare-except', 'python', 'error', 'security') r where lang = 'python' and category = 'security'",
    "a35_integrity": "select a.construct_id, hash_(a.text) = hash_(b.text) as intact from code_ a join code_ b on a.construct_id = b.construct_id",
    "a40_training_sample": "select construct_id, file from code_ c where length(text) <= 500 order by file, construct_id limit 200",
    "b01_path_exclusion": "select construct_id from code_ c where not (position('node_modules' in file) > 0 or position('dist' in file) > 0)",
    "b02_glob_exclusion": "select construct_id from code_ c where not matches_(file, '^src/tests/[^/]*$')",
    "b08_exceeded_thresholds": "select construct_id, array_text_(array_filter_(array(case when c > 4 then 'cyclomatic' end, case when n > 40 then 'lines' end), x -> x is not null), ',') as exceeds from (select construct_id, 1 + array_length_(regexp_extract_all(text, '" + _KEY + "', 0)) as c, array_length_(regexp_extract_all(text, '\\n', 0)) + 1 as n from code_ q) t",
    "b10_min_lines": "select construct_id from code_ c where array_length_(regexp_extract_all(text, '\\n', 0)) + 1 >= 30",
    "b11_precision_filters": "select name, count(*) as n from code_ c group by name having not bool_and(name in ('__init__', 'constructor')) and not (bool_and(matches_(name, '^(to_|from_|as_|into_)')) and count(distinct file) > 1) and sum(length(text)) - min(length(text)) >= 20",
    "b12_trivial_constructors": "select file, bool_and(name in ('__init__', 'constructor', '__new__', 'init')) as trivial from code_ c group by file",
    "b14_parallel_formatters": "select file, bool_and(matches_(name, '^(to_|from_|as_|into_)')) and count(distinct name) > 1 as parallel from code_ c group by file",
    "b15_min_savings": "select name, sum(length(text)) - min(length(text)) as savings from code_ c group by name having sum(length(text)) - min(length(text)) >= 20",
    "b16_comment_lines": "select construct_id, count(*) as n from code_lines_ c where matches_(line, '^[ ]*(#|//)') group by construct_id",
    "b17_magic_line_skip": "select construct_id, line_no from code_lines_ c where matches_(line, '[0-9]') and not matches_(line, '(?i)^[ ]*(#|//|import |const |def |return )') and not matches_(line, '^[ ]*[A-Z_]+ *=')",
    "b24_function_skip": "select construct_id from code_ c where not matches_(name, '^__.*__$|^test_')",
    "b25_public_api": "select construct_id, case when lang = 'python' then substring(name, 1, 1) <> '_' else true end as is_public from code_ c",
    "b26_test_file": "select file, case when matches_(file, 'test|spec') then -1 else 0 end as risk from code_ c group by file",
    "b27_reexport_file": "select construct_id, regexp_extract(file, '[^/]+$', 0) in ('m1.py', 'index.ts') as is_reexport from code_ c",
    "b33_fix_safety": "select construct_id, case when matches_(text, 'var x') then 'safe' when matches_(text, 'eval') then 'review' else 'none' end as safety from code_ c",
    "b34_reassigned": "select construct_id, max(case when line_no > 3 and matches_(line, '^[ ]*y = y') then 1 else 0 end) = 1 as reassigned from code_lines_ c group by construct_id",
    "b37_semantic_group": "select construct_id, case when position('async' in lower(text)) > 0 then 'async_operations' when position('try' in lower(text)) > 0 then 'error_handling' when position('class' in lower(text)) > 0 then 'class_definitions' when position('def ' in lower(text)) > 0 then 'function_definitions' else 'other' end as kind from code_ c",
    "b40_route_strategy": "select construct_id, case when matches_(file, 'test') then 'archival' when matches_(file, '[.]ts$') then 'ai_chat' else 'ai_analysis' end as strategy from code_ c",
    "b41_suffix_language": "select construct_id, case regexp_extract(file, '[.]([a-z]+)$', 1) when 'py' then 'python' when 'ts' then 'typescript' end as language from code_ c",
    "c06_orphan_files": f"select f.file from (select distinct file from code_ a) f left join (select distinct 'src/app/m' || substr(callee, 8) || '.py' as target from {_CALLS} b where callee like 'helper~_%' escape '~') e on f.file = e.target where e.target is null",
    "c07_orphan_functions": f"select d.name from (select distinct name from code_ a) d left join (select distinct callee from {_CALLS} b) u on u.callee = d.name where u.callee is null",
    "c08_external_references": f"select e.callee, case when d.name is null then 'external' else 'internal' end as kind, count(*) as n from {_CALLS} e left join (select distinct name from code_ b) d on d.name = e.callee group by 1, 2",
    "c10_test_coverage": "select distinct a.file from code_ a where exists (select 1 from code_ b where b.file = 'src/tests/test_m' || cast(cast(regexp_extract(a.file, 'm([0-9]+)[.]', 1) as int) % 10 as string_) || '.ts')",
    "c27_inherited_properties": "select prop, min(src) as src from (select name as prop, 'own' as src from code_ a where lang = 'python' union all select name, 'parent' from code_ b where lang = 'typescript') t group by prop",
    "c29_pattern_equivalents": "select c.construct_id, e.target from code_ c join (select 'python' as lang, 'print($X)' as pattern, 'console.log($X)' as target union all select 'typescript', 'console.log($X)', 'print($X)') e on c.lang = e.lang",
    "d09_issues_by_severity": "select severity, count(*) as n, count(distinct file) as files from (select file, 'critical' as severity from code_ a where matches_(text, 'eval[(]') union all select file, 'high' from code_ b where matches_(text, 'password *= *[\"]')) t group by severity",
    "d12_violations_by_rule": "select rule, count(*) as n from (select 'no-var' as rule from code_lines_ a where matches_(line, '^ *var ') union all select 'no-console-log' from code_lines_ b where matches_(line, 'console[.]log') union all select 'no-fixme' from code_lines_ c where matches_(line, 'FIXME')) t group by rule",
    "d15_group_statistics": "select count(*) as n_groups, cast(sum(n) as bigint) as members, cast(sum(n - 1) as bigint) as duplicates from (select hash_(text) as h, count(*) as n from documents group by 1 having count(*) > 1) t",
    "d16_group_suggestion": "select hash_(text) as h, count(*) as n, min(doc_id) as first_id, cast(sum(length(text)) - min(length(text)) as bigint) as savings from documents group by 1 having count(*) > 1",
    "d19_language_condense": "select lang, count(*) as files, cast(sum(length(text)) as bigint) as before, cast(sum(length(regexp_replace(text, ' +', ' '))) as bigint) as after from documents group by lang",
    "d20_reduction_estimates": "select r.strategy, cast(floor(t.total * (1 - r.pct / 100.0)) as bigint) as left_over from (select cast(sum(length(text)) as bigint) as total from documents) t cross join (select 'ai_chat' as strategy, 85 as pct union all select 'ai_analysis', 40 union all select 'archival', 30 union all select 'polyglot', 65) r",
    "d22_docs_coverage": "select lang, count_if(matches_(text, '# TODO')) as documented, count(*) as total from code_ c group by lang",
    "d24_matches_per_language": "select lang, count(*) as n from code_ c where matches_(text, 'while') group by lang",
    "d25_primary_language": "select ext from (select regexp_extract(file, '[.][a-z]+$', 0) as ext, count(*) as n from code_ c group by 1) t order by n desc, ext limit 1",
    "d32_orphan_totals": "select count(*) as n, cast(sum(length(text)) as bigint) as total from code_ c where name not like 'fn%'",
    "d35_routes_by_prefix": "select split_part(file, '/', 2) as prefix, count(*) as n from code_ c group by 1",
    "d38_files_scanned": "select count(distinct file) as n from code_ c where matches_(text, 'eval|password')",
    "e03_lagged_keywords": "select construct_id, line_no, coalesce(lag(kw) over (partition by construct_id order by line_no), '') || '>' || kw as step from (select construct_id, line_no, regexp_extract(line, '^ *(if|for|while|return|def) ?', 1) as kw from code_lines_ c) t where kw <> ''",
    "e05_base_indent": "select construct_id, ind as base from (select construct_id, length(regexp_extract(line, '^ *', 0)) as ind, row_number() over (partition by construct_id order by line_no) as r from code_lines_ c where trim(line) <> '') t where r = 1",
    "e06_nesting_depth": "select construct_id, cast(max(floor(length(regexp_extract(line, '^ *', 0)) / 4)) as int) as depth from code_lines_ c where trim(line) <> '' group by construct_id",
    "e07_line_numbers": "select doc_id, count(*) as n_lines, max(line_no) as last_line from lines_ l group by doc_id",
    "e17_import_section": "select construct_id, max(case when matches_(line, '^def ') then line_no end) as at from code_lines_ c group by construct_id",
    "f07_issue_sort": "select construct_id, sev from (select construct_id, file, case when matches_(text, 'eval') then 'error' else 'info' end as sev from code_ c) t order by case sev when 'error' then 0 else 2 end, file, construct_id",
    "f08_search_relevance": "select construct_id, rel from (select construct_id, case when position('3' in name) > 0 then 2 else 0 end + case when position('fixme' in lower(text)) > 0 then 1 else 0 end as rel from code_ c) t where rel > 0 order by rel desc, construct_id limit 100",
    "g05_keyword_jaccard": "select a.construct_id, round(array_length_(array_both_(a.k, b.k)) * 1.0 / (array_length_(a.k) + array_length_(b.k) - array_length_(array_both_(a.k, b.k))), 6) as j from (select construct_id, array_unique_(regexp_extract_all(text, '(if|for|while|return|eval|print|var)', 0)) as k from code_ x) a join (select construct_id - 1 as construct_id, array_unique_(regexp_extract_all(text, '(if|for|while|return|eval|print|var)', 0)) as k from code_ y) b on a.construct_id = b.construct_id",
    "h01_tokens": "select construct_id, array_length_(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_ \\n]', 0)) as n from code_ c",
    "h02_token_shingles": "select construct_id, array_text_(array_map_(numbers_(1, greatest(array_length_(t) - 2, 1)), i -> array_text_(slice_(t, i, 3), ' ')), '|') as s from (select construct_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*', 0) as t from code_ c) q",
    "h09_cyclomatic": "select construct_id, 1 + array_length_(regexp_extract_all(text, '" + _KEY + "', 0)) + array_length_(regexp_extract_all(text, ' and | or ', 0)) as cyclomatic from code_ c",
    "h10_cognitive": "select construct_id, cast(sum(case when matches_(line, '^ *(if|for|while|elif) ') then 1 + greatest(0, floor(length(regexp_extract(line, '^ *', 0)) / 4) - 1) else 0 end + case when matches_(line, ' and | or ') then 1 else 0 end) as bigint) as cognitive from code_lines_ c group by construct_id",
    "h11_line_keyword": "select construct_id, line_no, regexp_extract(line, '^ *(if|for|while|elif|return)([ (:]|$)', 1) as kw from code_lines_ c where matches_(line, '^ *(if|for|while|elif|return)([ (:]|$)')",
    "h12_operator_sequence": "select construct_id, line_no, array_text_(regexp_extract_all(line, '(and|or)', 0), ',') as ops from code_lines_ c where matches_(line, ' and | or ')",
    "h13_parameter_count": "select construct_id, array_length_(regexp_extract_all(regexp_extract(text, '[(]([^)]*)[)]', 1), ',', 0)) + 1 as params from code_ c",
    "h16_node_sequence": "select construct_id, array_text_(array_sorted_(array_unique_(regexp_extract_all(text, '(if|for|while|return|def)', 0))), '>') as nodes from code_ c",
    "h20_size_bucket": "select construct_id, case when n <= 5 then 0 when n <= 10 then 1 when n <= 20 then 2 when n <= 40 then 3 when n <= 80 then 4 when n <= 160 then 5 when n <= 320 then 6 else 7 end as bucket from (select construct_id, array_length_(regexp_extract_all(text, '\\n', 0)) + 1 as n from code_ c) t",
    "h21_structure_hash": "select construct_id, hash_(array_text_(regexp_extract_all(text, '(if|for|while|return|def)', 0), '|')) as h from code_ c",
    "h22_secrets": "select doc_id, line_no, position('token = ' in lower(line)) as col from lines_ l where matches_(line, '(?i)token *= *[\"][a-z0-9]{20,}|[a-z0-9]@[a-z0-9]+[.]')",
    "h23_magic_numbers": "select construct_id, array_text_(array_filter_(regexp_extract_all(text, '[0-9]+', 0), x -> not array_has_(array('0', '1', '2', '10', '100'), x)), ',') as found from code_ c",
    "h24_identifiers": "select construct_id, array_text_(array_sorted_(array_filter_(array_unique_(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*', 0)), x -> not array_has_(array('if', 'for', 'while', 'def', 'return', 'and', 'or', 'in'), x))), ',') as ids from code_ c",
    "h25_literals": "select construct_id, array_text_(regexp_extract_all(text, '[\"][^\"]*[\"]', 0), ',') as lits from code_ c where matches_(text, '[\"]')",
    "h26_generalise": "select construct_id, regexp_replace(regexp_replace(text, '[0-9]+', 'NUM'), '[\"][^\"]*[\"]', 'STR') as pattern from code_ c",
    "h27_normalise": "select doc_id, length(regexp_replace(regexp_replace(text, '[ ]+\\n', chr(10)), '\\n\\n\\n+', chr(10) || chr(10))) as n from documents",
    "h28_strip_debug": "select construct_id, count(*) as kept from code_lines_ c where not matches_(line, '^ *(print[(]|console[.]log)') group by construct_id",
    "h30_braces": "select construct_id, array_length_(regexp_extract_all(regexp_replace(text, '[\"][^\"]*[\"]', ''), '[(]', 0)) - array_length_(regexp_extract_all(regexp_replace(text, '[\"][^\"]*[\"]', ''), '[)]', 0)) as balance from code_ c",
    "h34_split_names": "select construct_id, lower(regexp_replace(name, '_+', ' ')) as words from code_ c",
    "h37_case_conversion": "select p_partkey, upper(substring(p_brand, 1, 1)) || lower(substring(p_brand, 2)) as pascal from part",
    "h39_type_names": "select construct_id, regexp_replace(file, '[.]py$', '.ts') as converted from code_ c",
    "h40_entity_id": "select p_partkey, 'https://example.com/#' || lower(p_brand) || '-' || cast(p_partkey as string_) as id from part",
    "i14_cosine": "select a.vec_id as a, b.vec_id as b, round((dot_(a.embedding, b.embedding) / (sqrt(dot_(a.embedding, a.embedding)) * sqrt(dot_(b.embedding, b.embedding))) + 1) / 2, 4) as sim from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
    "i24_content_hash": "select doc_id, hash_(text) as h from documents",
    "j03_shingle_jaccard": "select a.construct_id, round(array_length_(array_both_(a.s, b.s)) * 1.0 / greatest(1, array_length_(a.s) + array_length_(b.s) - array_length_(array_both_(a.s, b.s))), 6) as j from (select construct_id, array_unique_(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*', 0)) as s from code_ x) a join (select construct_id - 1 as construct_id, array_unique_(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*', 0)) as s from code_ y) b on a.construct_id = b.construct_id",
    "k02_reverse_adjacency": f"select callee, count(distinct file) as importers, min(file) as first_file from {_CALLS} c where callee like 'helper~_%' escape '~' group by callee",
    "k01_import_edges": f"select distinct file as source, 'src/app/m' || substr(callee, 8) || '.py' as target from {_CALLS} c where callee like 'helper~_%' escape '~'",
    "b30_links": "select page_id, array_length_(regexp_extract_all(html, 'href=[\"][^\"]*[\"]', 0)) as n_links from pages",
}


#: Lines that a scope takes after its first.
SCOPE = 30


def char_shingles(text: Column) -> Column:
    """The runs of three characters of a text with `|` between them; a shorter text as it is.

    Each character but the last two is followed by the two after it, in one pass: to cut run after run out of a text, as ``substring`` does, takes
    the square of its length, since it counts its characters from the start each time.
    """
    runs = F.regexp_replace(text, "(?s)(.)(?=(..))", "$1$2|")
    return F.when(F.length(text) < 3, text).otherwise(F.substring(runs, F.lit(1), F.length(runs) - 3))


def innermost(points: DataFrame, scopes: DataFrame) -> DataFrame:
    """The columns of ``points`` (file, at, others), scope_start: the last start of a scope (file, start_line) of the file whose lines hold the point.

    Points without a scope and null files are left out. Each place and each start counts once, and a place asks for the lines a scope could have
    started at: the join is on equal numbers, and what it makes is bounded by the places.
    """
    starts = scopes.select("file", F.col("start_line").alias("start")).dropna().distinct()
    asked = points.select("file", "at").dropna().distinct().withColumn("start", F.explode(F.sequence(F.col("at") - SCOPE, F.col("at"))))
    found = asked.join(starts, ["file", "start"]).groupBy("file", "at").agg(F.max("start").alias("scope_start"))
    return points.join(found.hint("shuffle_merge"), ["file", "at"])


def _shingled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialect.run(spark, sf_dir, "select doc_id, text from documents where text is not null").select("doc_id", char_shingles(F.col("text")).alias("s"))


def _innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dialect.run(spark, sf_dir, "select construct_id, file, start_line, start_line + 5 as at from code_ c")
    return innermost(rows.select("construct_id", "file", "at"), rows).select("construct_id", "scope_start")


FRAMES = {"c21_innermost_scope": _innermost, "h03_char_shingles": _shingled}
FRAME_ORACLES = {
    "c21_innermost_scope": dialect.duck_sql("select p.construct_id, max(s.start_line) as scope_start from (select construct_id, file, start_line + 5 as at from code_ x) p join (select file, start_line, start_line + 30 as end_line from code_ y) s on p.file = s.file and p.at between s.start_line and s.end_line group by p.construct_id"),
    "h03_char_shingles": dialect.duck_sql("select doc_id, array_text_(array_map_(numbers_(1, greatest(length(text) - 2, 1)), i -> substring(text, cast(i as int), 3)), '|') as s from documents where text is not null"),
}
