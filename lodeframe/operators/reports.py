"""Structured data, documentation, coverage, scopes and reports, on derived tables (see ``dialect``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.plans import dialect

_HTML = """(select entity, case when entity % 3 = 0 then '<script type="application/ld+json">{"@type": "' || type_a || '", "name": "n"}</script>' when entity % 10 = 1 then '<script type="application/ld+json">{broken</script>' else '' end
  || case when entity % 2 = 0 then '<div itemscope itemtype="https://schema.org/' || type_a || '"><b itemprop="name">x</b></div>' when entity % 5 = 0 then '<div itemscope><i itemprop="url">u</i></div>' else '' end
  || case when entity % 4 = 1 then '<span property="name">x</span><span typeof="' || type_a || '" property="url">y</span>' else '' end as html from entities_ e)"""
_LD = r"""r'(?s)<script type="application/ld\+json">(.*?)</script>'"""
_DOC = """(select p_partkey as id, case p_partkey % 4 when 0 then 'Args:' || chr(10) || '    size (int): how large' || chr(10) || '    brand: which' when 1 then ':param size: how large' || chr(10) || ':param int kind: which' when 2 then '@param {number} size how large' || chr(10) || '@param brand which' else 'No parameters.' end as doc, case p_partkey % 5 when 0 then 'get_user_name' when 1 then 'is_valid' when 2 then 'create_order' when 3 then '_hidden' else 'run' end as name from part)"""
_ISSUES = "(select construct_id, file, line_no, case when matches_(line, r'eval\\(|password *=') then 'error' when matches_(line, 'TODO|FIXME|var ') then 'warning' else 'info' end as severity, case when matches_(line, r'eval\\(') then 'no-eval-exec' when matches_(line, 'password *=') then 'no-secrets' when matches_(line, 'TODO|FIXME') then 'no-todo' when matches_(line, 'var ') then 'no-var' else 'no-print' end as rule from code_lines_ c where matches_(line, r'eval\\(|password *=|TODO|FIXME|var |print\\('))"
_RANK = "case severity when 'error' then 0 when 'warning' then 1 else 2 end"
_FUNCTIONS = r"(select construct_id, file, lang, name, text, 1 + array_length_(regexp_extract_all(text, '(if |elif |for |while )', 0)) + array_length_(regexp_extract_all(text, ' and | or ', 0)) as cyclomatic, array_length_(regexp_extract_all(text, '\n', 0)) + 1 as n_lines, array_length_(regexp_extract_all(regexp_extract(text, r'\(([^)]*)\)', 1), ',', 0)) + 1 as params from code_ c)"
_CASES = "(select p_partkey as id, case p_size % 5 when 0 then 'literal' when 1 then 'identifier' when 2 then 'expression' when 3 then 'type' else 'logic' end as category, case p_partkey % 3 when 0 then 'low' when 1 then 'medium' else 'high' end as severity from part)"
_SCORE = "case category when 'literal' then 1 when 'identifier' then case severity when 'low' then 1 when 'medium' then 2 else 3 end when 'expression' then case severity when 'high' then 5 else 3 end when 'type' then case severity when 'high' then 6 else 4 end else case severity when 'high' then 7 else 6 end end"

QUERIES = {
    "b04_exclude_patterns": "select construct_id, file from code_ c where not (matches_(file, '^src/tests/.*') or matches_(file, '(^|/)node_modules(/|$)') or array_has_(regexp_extract_all(file, '[^/]+', 0), 'm7.py'))",
    "b13_delegation_wrappers": r"""select id from (select p_partkey as id, case p_size % 4 when 0 then 'return self.inner.run(a)' when 1 then 'x = 1' || chr(10) || 'return other(a)' when 2 then 'return a + 1' else 'y = 2' || chr(10) || 'z = 3' || chr(10) || 'call(y)' end as body from part) t
      where array_length_(regexp_extract_all(body, '\n', 0)) + 1 <= 2 and matches_(body, r'(^|\n)(return )?(self[.]\w+([.]\w+)*|super\(\)[.]\w+|\w+)\(')""",
    "b18_magic_number_noise": "select construct_id, line_no, regexp_extract(line, '([0-9]+)', 1) as number from code_lines_ c where matches_(line, '[0-9]') and not matches_(line, r'\\[[0-9]+\\]|range\\([0-9]+\\)|[A-Za-z_][0-9]+|\"[^\"]*[0-9]+[^\"]*\"')",
    "b31_docstring_skip": f"select id from {_DOC} d where not matches_(name, '^_') and doc = 'No parameters.'",
    "b36_entity_shape": "select id, label is not null and position('#' in id) > 0 as valid, type_a in ('Organization', 'Product', 'WebSite', 'Service') as known from entities_ e",
    "c12_batch_coverage": "select a.file, count(distinct t.construct_id) as tests from (select distinct file, regexp_extract(file, 'm([0-9]+)[.]', 1) as stem from code_ x where not matches_(file, 'test')) a left join (select construct_id, regexp_extract(file, 'test_m([0-9]+)[.]', 1) as stem from code_ y where matches_(file, 'test')) t on t.stem = a.stem group by a.file",
    "c20_import_references": "select target, count(*) as n, count(distinct source) as files from (select source, level, module as target from imports_ i where level >= 0) t group by target",
    "d34_variation_summary": f"select category, count(*) as n, cast(sum({_SCORE}) as bigint) as total, max({_SCORE}) as most from {_CASES} c group by category",
    "e09_docstring_lines": "select construct_id, line_no from (select construct_id, line_no, line, sum(case when matches_(line, '^ *# TODO') then 1 else 0 end) over (partition by construct_id order by line_no) as seen from code_lines_ c) t where seen = 1 and matches_(line, '^ *#')",
    "e12_brace_scopes": "select construct_id, line_no, depth from (select construct_id, line_no, sum(array_length_(regexp_extract_all(line, ':$', 0)) - case when trim(line) = '' then 1 else 0 end) over (partition by construct_id order by line_no) as depth from code_lines_ c) t where depth > 1",
    "f03_top_candidates": "select file, n from (select file, count(*) as n from code_ c group by file) t order by n desc, file limit 10",
    "f10_section_order": "select section, weight from (select 'installation' as section, 2 as weight union all select 'title', 0 union all select 'usage', 3 union all select 'features', 1 union all select 'license', 9) t order by weight",
    "g02_issue_types": f"select distinct kind from (select rule as kind from {_ISSUES} i union select severity from {_ISSUES} j) t",
    "h14_docstring_length": f"select id, array_length_(regexp_extract_all(doc, '\\n', 0)) + 1 as n from {_DOC} d",
    "h15_methods_of_files": "select file, count(distinct name) as methods from code_ c where not matches_(name, '^__') group by file",
    "h17_control_complexity": "select construct_id, count(*) as complexity from (select construct_id, regexp_extract(trim(line), '^(if|elif|for|while|except|case|with)( |:)', 1) as kw from code_lines_ c) t where kw <> '' group by construct_id",
    "h33_documented_parameters": f"select id, array_text_(regexp_extract_all(doc, r'(?::param (?:int )?|@param (?:\\{{[^}}]*\\}} )?|\\n    )([A-Za-z_]+)', 1), ',') as params from {_DOC} d",
    "h35_describe_names": f"select id, case when name like 'get_%' then 'Get ' || replace(substring(name, 5), '_', ' ') when name like 'is_%' then 'Check if ' || replace(substring(name, 4), '_', ' ') when name like 'create_%' then 'Create ' || replace(substring(name, 8), '_', ' ') else replace(name, '_', ' ') end as said from {_DOC} d",
    "h41_linked_data": f"select entity, length(content) as raw_length, nullif(regexp_extract(content, r'\"@type\":\\s*\"([^\"]+)\"', 1), '') as type, matches_(content, r'(?s)^\\s*[{{].*[}}]\\s*$') as parsed from (select entity, regexp_extract(html, {_LD}, 1) as content from {_HTML} h) t where content <> ''",
    "h42_microdata": f"select entity, array_length_(regexp_extract_all(html, r'\\bitem(scope|type|prop|id|ref)\\b', 0)) as attributes, nullif(regexp_extract(html, r'itemtype=\"https?://schema[.]org/([A-Za-z]+)\"', 1), '') as type, matches_(html, r'itemscope\\s*>') as lacks_type from {_HTML} h where position('itemscope' in html) > 0",
    "h43_rdfa": f"select entity, array_text_(regexp_extract_all(html, r'\\b(property|typeof|vocab|resource)=', 1), ',') as attributes from {_HTML} h where matches_(html, r'\\b(property|typeof|vocab|resource)=')",
    "h45_text_matches": f"select construct_id, file || ':' || cast(line_no as string_) || ': ' || rule as said from {_ISSUES} i",
    "h48_call_depth": "select construct_id, max(case when matches_(line, r'\\w\\([^()]*\\w\\([^()]*\\w\\(') then 3 when matches_(line, r'\\w\\([^()]*\\w\\(') then 2 when matches_(line, r'\\w\\(') then 1 else 0 end) as depth from code_lines_ c group by construct_id",
    "i03_risk_score": "select file, round(100 * case when tests > 2 then cast(1.0 as double) when tests > 0 then cast(0.7 as double) else cast(0.3 as double) end * cast(0.25 as double), 6) as score from (select file, count_if(construct_id % 9 = 0) as tests from code_ c group by file) t",
    "i12_variation_scores": f"select id, category, severity, {_SCORE} as score, case when {_SCORE} <= 2 then 'trivial' when {_SCORE} <= 4 then 'simple' else 'complex' end as level from {_CASES} c",
    "i23_scalar_or_list": "select id, array_length_(array_filter_(array(type_a, type_b), x -> x is not null)) as n from entities_ e",
    "i27_score_key": "select construct_id, sha2('{\"file\": \"' || file || '\", \"name\": \"' || name || '\"}', 256) as score_key from code_ c",
    "j18_classify": f"select id, category, severity, severity in ('low', 'medium') as parameterizable from {_CASES} c",
    "l14_polyglot_rename": "select lang, count(*) as changes, count(distinct file) as files, case when count(distinct lang) > 1 then 'high' when count(*) > 20 then 'medium' else 'low' end as risk from (select c.lang, c.file, c.line from code_lines_ c where matches_(c.line, r'\\bhelper_3\\b')) t group by lang",
    "l20_templates": "select p_partkey, replace(replace('def {{name}}({{args}}):' || case when p_size > 25 then chr(10) || '    # large' else '' end, '{{name}}', lower(p_brand)), '{{args}}', case when p_size % 2 = 0 then 'a, b' else 'a' end) as code from part",
    "l21_docstrings": r"""select construct_id, name || ' of ' || file || chr(10) || chr(10) || 'Args:' || chr(10) || '    ' || array_text_(array_map_(regexp_extract_all(params, '[A-Za-z_]+', 0), x -> x || ': the ' || x), chr(10) || '    ') as doc from (select construct_id, name, file, regexp_extract(text, r'\(([^)]*)\)', 1) as params from code_ c) t""",
    "l24_route_docs": "select method, path, count(*) as handlers from (select case p_size % 3 when 0 then 'get' when 1 then 'post' else 'delete' end as method, '/' || lower(p_brand) || '/{id}' as path from part) t group by method, path",
    "l26_documentation_issues": f"select id, 'undocumented' as issue from {_DOC} d where doc = 'No parameters.' and not matches_(name, '^_') union all select id, 'stale parameter' from {_DOC} e where position('brand' in doc) > 0",
    "l32_quality_report": f"select severity, rule, count(*) as n, count(distinct file) as files, round(100.0 * count(*) / sum(count(*)) over (), 4) as share from {_ISSUES} i group by severity, rule",
    "l33_duplication_report": "select level, count(*) as groups, cast(sum(n) as bigint) as members from (select n, case when n >= 10 then 'high' when n >= 3 then 'medium' else 'low' end as level from (select name, count(*) as n from code_ c group by name having count(*) > 1) g) t group by level",
    "l39_enforcement": f"select construct_id, file, line_no, rule, severity from {_ISSUES} i where {_RANK} <= 1",
    "l40_smells": f"select construct_id, 'long_function' as smell, n_lines as amount, case when n_lines >= 100 then 'high' when n_lines >= 75 then 'medium' else 'low' end as severity from {_FUNCTIONS} f where n_lines > 50 union all select construct_id, 'many_parameters', params, case when params >= 10 then 'high' when params >= 8 then 'medium' else 'low' end from {_FUNCTIONS} g where params > 5 union all select construct_id, 'complex', cyclomatic, 'medium' from {_FUNCTIONS} h where cyclomatic > 4",
    "l41_complexity_report": f"select lang, count(*) as functions, round(avg(cyclomatic), 4) as mean, max(cyclomatic) as most, count_if(cyclomatic > 4 or n_lines > 50) as exceeding from {_FUNCTIONS} f group by lang",
    "l43_search_by_language": "select lang, construct_id, place from (select lang, construct_id, row_number() over (partition by lang order by construct_id) as place from code_ c where matches_(text, r'\\bwhile\\b')) t where place <= 100",
    "l44_change_impact": "select callee, count(*) as calls, count(distinct file) as files, case when count(distinct file) > 10 then 'high' when count(distinct file) > 3 then 'medium' else 'low' end as risk from (select file, regexp_extract(line, r'\\b(helper_[0-9]+)\\(', 1) as callee from code_lines_ c) t where callee <> '' group by callee",
    "l46_structured_data_report": f"select entity, case when position('ld+json' in html) > 0 then 1 else 0 end + case when position('itemscope' in html) > 0 then 1 else 0 end + case when position('property=' in html) > 0 then 1 else 0 end as formats, matches_(html, r'itemscope\\s*>|ld[+]json\">[{{]broken') as faulty from {_HTML} h",
    "c11_coverage_by_reference": "select s.stem, count(t.construct_id) > 0 as covered from (select distinct 'helper_' || cast(construct_id % 20 as string_) as stem from code_ s0) s left join (select construct_id, regexp_extract(text, r'\\b(helper_[0-9]+)\\b', 1) as stem from code_ t0 where matches_(file, 'test')) t on t.stem = s.stem group by s.stem",
    "g06_merged_excludes": "select p_partkey, array_text_(array_unique_(array('node_modules', 'dist', 'venv', lower(p_brand), 'dist', case when p_size % 2 = 0 then 'venv' else 'build' end)), ',') like '%build%' as has_build from part",
    "f06_head": "select id, type_a from entities_ e order by id limit 25",
    "a41_ignored_paths": "select c.construct_id, max(x.kind) as kind from code_ c join (select 'node_modules/' as part, 'excluded' as kind union all select 'tests/', 'test' union all select '.min.', 'minified') x on position(x.part in c.file) > 0 group by c.construct_id",
    "b29_entity_ids": "select id, array_text_(array_filter_(array(case when position('#' in id) = 0 then 'no fragment' end, case when not matches_(id, '^https?://') then 'not absolute' end, case when matches_(id, ' ') then 'space' end, case when matches_(id, '[0-9]{4,}') then 'looks generated' end), x -> x is not null), ',') as warnings from entities_ e",
    "k06_graph_report": "select e.site, count(*) as entities, count(distinct e.type_a) as types, count_if(k.known is null) as broken from entities_ e left join (select id as known from entities_ f) k on e.ref = k.known group by e.site",
    "l18_extracted_functions": "select name, 'def ' || lower(name) || '_shared(' || case when count(*) > 2 then 'value, key' else 'value' end || '):' || chr(10) || '    return value' as code, count(*) as copies from code_ c group by name having count(*) > 1",
    "l27_bindings": "select p_partkey, case p_size % 3 when 0 then 'get' when 1 then 'create' else 'delete' end || replace(p_brand, '#', '_') as method, 'return self.request(\"' || case p_size % 3 when 0 then 'GET' when 1 then 'POST' else 'DELETE' end || '\", \"/' || lower(p_brand) || '\")' as body from part",
    "l28_conversion_warnings": "select construct_id, array_text_(array_filter_(array(case when matches_(text, r'\\beval\\(') then 'eval' end, case when matches_(text, r'\\brange\\(') then 'range' end, case when matches_(text, 'while ') then 'while' end), x -> x is not null), ',') as warnings from code_ c where lang = 'python'",
    "l29_condensed": "select lang, count(*) as kept, cast(sum(length(trim(line))) as bigint) as size from code_lines_ c where trim(line) <> '' and not matches_(line, r'^\\s*(#|//|print\\(|console[.]log)') group by lang",
    "l42_orphan_report": "select 'file' as kind, f.file as name from (select distinct file from code_ a) f left join (select distinct 'src/app/m' || regexp_extract(text, 'helper_([0-9]+)', 1) || '.py' as target from code_ b) e on f.file = e.target where e.target is null union all select 'function', d.name from (select distinct name from code_ c) d left join (select distinct regexp_extract(text, '(helper_[0-9]+)[(]', 1) as callee from code_ g) u on u.callee = d.name where u.callee is null",
    "l45_equivalents": "select q.word, min(p.target) as target, max(case when p.concept = q.word then 'direct' else 'fuzzy' end) as how from (select distinct lower(p_brand) || case when p_size % 2 = 0 then ' list comprehension' else '' end as word from part) q join (select 'list comprehension' as concept, 'map' as target union all select 'dictionary', 'object' union all select 'comprehension', 'flatMap') p on position(p.concept in q.word) > 0 group by q.word",
}


def references(lines: DataFrame, stems: DataFrame) -> DataFrame:
    """stem, n, files of ``stems`` (stem): how many ``lines`` (construct_id, file, stem) name one, in how many files; 0 where none does.

    Lines are counted before they meet the stems, so that a stem that many lines name, or the empty one of lines that name none, burdens no task.
    """
    counted = lines.groupBy("stem").agg(F.count("construct_id").alias("n"), F.countDistinct("file").alias("files"))
    return stems.distinct().join(counted, "stem", "left").select("stem", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("files", F.lit(0)).alias("files"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dialect.run(spark, sf_dir, r"select construct_id, file, regexp_extract(line, r'\b(helper_[0-9]+)\b', 1) as stem from code_lines_ c")
    return references(lines, dialect.run(spark, sf_dir, "select 'helper_' || cast(construct_id % 25 as string_) as stem from code_ c"))


FRAMES = {"c09_textual_references": _references}
FRAME_ORACLES = {
    "c09_textual_references": dialect.duck_sql("select f.stem, count(r.construct_id) as n, count(distinct r.file) as files from (select distinct 'helper_' || cast(construct_id % 25 as string_) as stem from code_ f0) f left join (select construct_id, file, regexp_extract(line, r'\\b(helper_[0-9]+)\\b', 1) as stem from code_lines_ c) r on r.stem = f.stem group by f.stem"),
}
