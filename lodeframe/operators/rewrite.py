"""Patterns, line fixes, renames, variations and reports, on the generated code corpus."""

# What a metavariable may look like, and what is wrong with it.
_PATTERN = "(select p_partkey as id, case p_partkey % 8 when 0 then '$NAME' when 1 then '$$ARG' when 2 then '$$$ARGS' when 3 then '$_X' when 4 then '$name' when 5 then '$1X' when 6 then '$A-B' else 'plain' end || case when p_size % 2 = 0 then '($$$)' else '' end as pattern from part)"
_NULL_EQUALITY = r"r'(^|[^=!])(==|!=)\s*(null|undefined)\b|\b(null|undefined)\s*(==|!=)([^=]|$)'"
_LOOSE = "(select construct_id, line_no, case when line_no % 4 = 0 then 'if (x == ' || cast(line_no as string_) || ' && y == 2)' when line_no % 4 = 1 then 'if (x == null)' when line_no % 4 = 2 then 'while (a != b)' else line end as line from code_lines_ c)"
_INDENT = "length(regexp_extract(line, '^ *', 0))"
_CALLS = "array_sorted_(array_unique_(array_filter_(regexp_extract_all(text, r'\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1), x -> not array_has_(array('if', 'for', 'while', 'print', 'range', 'len', 'eval', 'def'), x) and x <> name)))"
_PAIRS = "(select a.construct_id as a, b.construct_id as b, a.text as old_text, b.text as new_text from code_ a join code_ b on b.construct_id = a.construct_id + 40)"
_NUMBERS = "r'[0-9]+'"
_NAMES = "r'[A-Za-z_][A-Za-z0-9_]*'"
_REFERENCES = "(select construct_id, file, line_no, line, case when matches_(line, r'^\\s*(def|function|class)\\s+helper_3\\b') then 'definition' when matches_(line, r'^\\s*(import|from)\\b') then 'import' when matches_(line, r'\\bhelper_3\\s*\\(') then 'call' else 'reference' end as kind from code_lines_ c where matches_(line, r'\\bhelper_3\\b'))"
_VIOLATIONS = "(select construct_id, file, line_no, case when matches_(line, r'eval\\(') then 'error' when matches_(line, 'FIXME') then 'warning' else 'info' end as severity, case when matches_(line, r'eval\\(') then 'no-eval-exec' when matches_(line, 'FIXME') then 'no-fixme' else 'no-print-production' end as rule from code_lines_ c where matches_(line, r'eval\\(|FIXME|print\\('))"
_SEVERITY = "case severity when 'error' then 0 when 'warning' then 1 else 2 end"
_PARAMS = "(select p_partkey as id, array('a', 'b', case when p_size % 3 = 0 then 'c' else 'd' end) as actual, array('a', case when p_size % 2 = 0 then 'b' else 'x' end, case when p_size % 5 = 0 then 'c' else 'd' end) as doc from part)"
# The terms of a query and the construct that the first of them in it stands for.
_TERMS = [("async", "async_function"), ("await", "async_function"), ("asynchronous", "async_function"), ("function", "function"), ("method", "function"), ("def", "function"), ("class", "class"), ("struct", "class"), ("try", "try_catch"), ("catch", "try_catch"), ("except", "try_catch"), ("error", "try_catch"), ("exception", "try_catch"), ("import", "import"), ("require", "import"), ("use", "import"), ("if", "if_statement"), ("conditional", "if_statement"), ("for", "for_loop"), ("loop", "for_loop"), ("foreach", "foreach"), ("iterate", "foreach"), ("lambda", "arrow_function"), ("arrow", "arrow_function"), ("closure", "arrow_function")]

QUERIES = {
    "b22_metavariables": f"select id, case when matches_(pattern, r'\\$\\$\\$([A-Z][A-Z0-9_]*)?') then 'multi' when matches_(pattern, r'\\$\\$([A-Z][A-Z0-9_]*)') then 'unnamed' when matches_(pattern, r'\\$_([A-Z][A-Z0-9_]*)?') then 'non_capturing' when matches_(pattern, r'\\$([A-Z][A-Z0-9_]*)') then 'single' else 'none' end as kind from {_PATTERN} p",
    "b23_pattern_issues": f"select id, array_text_(array_filter_(array(case when matches_(pattern, r'\\$([a-z][a-zA-Z0-9_]*)') then 'lowercase' end, case when matches_(pattern, r'\\$(\\d[A-Z0-9_]*)') then 'digit_start' end, case when matches_(pattern, r'\\$([A-Z][A-Z0-9]*-[A-Z0-9_-]*)') then 'hyphen' end), x -> x is not null), ',') as issues from {_PATTERN} p",
    "b07_smell_severity": f"select construct_id, line_no from {_VIOLATIONS} v where severity = 'warning'",
    "b09_exceeding": "select construct_id, c, n from (select construct_id, 1 + array_length_(regexp_extract_all(text, '(if |elif |for |while )', 0)) as c, array_length_(regexp_extract_all(text, '\\n', 0)) + 1 as n from code_ x) t where c > 4 or n > 40 order by c + n desc, construct_id",
    "b32_fix_type": f"select construct_id, line_no, rule from {_VIOLATIONS} v where rule in ('no-print-production')",
    "b35_null_equality": f"select construct_id, line_no from {_LOOSE} l where matches_(line, {_NULL_EQUALITY})",
    # The first term of the ordered list that the query holds wins, else function.
    "b38_query_terms": "select doc_id, case " + " ".join(f"when position('{t}' in lower(text)) > 0 then '{k}'" for t, k in _TERMS) + " else 'function' end as construct from documents where text is not null",
    "b39_manual_review": "select construct_id, file from code_ c where matches_(file, '[.](ts|json|yaml|md)$') and matches_(text, r'\\bhelper_3\\b')",
    "c19_external_call_sites": f"select r.file, count(*) as n from {_REFERENCES} r where r.kind = 'call' and r.file <> 'src/app/m3.py' group by r.file",
    "c22_name_conflicts": "select r.file, r.line_no, r.construct_id from (select construct_id, file, line_no from code_lines_ c where matches_(line, r'^\\s*y = ')) r join (select construct_id, min(line_no) as line_no from code_lines_ d where matches_(line, r'\\by\\b') group by construct_id) s on r.construct_id = s.construct_id and r.line_no = s.line_no",
    "c23_parameter_sync": f"select id, array_text_(array_filter_(doc, x -> not array_has_(actual, x)), ',') as only_documented, array_text_(array_filter_(actual, x -> not array_has_(doc, x)), ',') as undocumented from {_PARAMS} p",
    "c24_broken_links": "select p.page_id, p.link from (select distinct page_id, unnested_(regexp_extract_all(html, 'href=[\"]([^\"]*)[\"]', 1)) as link from pages) p left join (select distinct url from pages) u on p.link = u.url where p.link <> '' and u.url is null",
    "c32_variable_use": "select construct_id, max(case when line_no < 5 and matches_(line, r'\\ba\\b') then 1 else 0 end) = 1 as used_before, max(case when line_no between 5 and 8 and matches_(line, r'\\by\\s*=') then 1 else 0 end) = 1 as changed_in, max(case when line_no > 8 and matches_(line, r'\\by\\b') then 1 else 0 end) = 1 as used_after from code_lines_ c group by construct_id",
    "c30_type_mapping": "select c.construct_id, coalesce(m.target, 'any') as target from (select construct_id, case construct_id % 4 when 0 then 'str' when 1 then 'int' when 2 then 'list' else 'Decimal' end as source from code_ x) c left join (select 'str' as source, 'string' as target union all select 'int', 'number' union all select 'list', 'Array') m on c.source = m.source",
    "d10_violations_by_file": f"select file, count(*) as n, count(distinct rule) as rules, min({_SEVERITY}) as worst from {_VIOLATIONS} v group by file",
    "d23_category_counts": f"select rule, severity, count(*) as n, count(distinct file) as files from {_VIOLATIONS} v group by rule, severity",
    "d36_references_by_file": f"select file, kind, count(*) as n, min(line_no) as first_line from {_REFERENCES} r group by file, kind",
    "e04_operator_runs": "select construct_id, line_no, 1 + array_length_(array_filter_(numbers_(1, array_length_(ops)), i -> array_length_(array_unique_(slice_(ops, i, 2))) = 2)) as runs from (select construct_id, line_no, regexp_extract_all(line, r' (and|or) ', 1) as ops from code_lines_ c) t where array_length_(ops) > 0",
    "e08_brace_depth": "select construct_id, line_no, sum(delta) over (partition by construct_id order by line_no) as depth from (select construct_id, line_no, array_length_(regexp_extract_all(line, '[(]', 0)) - array_length_(regexp_extract_all(line, '[)]', 0)) as delta from code_lines_ c) t",
    # The scope of a line is the last line before it that opens a block with less indent.
    "e11_scope_tree": f"select c.construct_id, c.line_no, max(p.line_no) as parent from (select construct_id, line_no, {_INDENT} as ind from code_lines_ c1 where matches_(line, ':$')) c join (select construct_id, line_no, {_INDENT} as ind from code_lines_ c2 where matches_(line, ':$')) p on p.construct_id = c.construct_id and p.line_no < c.line_no and p.ind < c.ind group by c.construct_id, c.line_no",
    "e16_sorted_violations": f"select construct_id, line_no, row_number() over (partition by file order by {_SEVERITY}, line_no, construct_id, rule) as place from {_VIOLATIONS} v",
    "f05_violation_cap": f"select construct_id, line_no, rule from {_VIOLATIONS} v order by {_SEVERITY}, file, line_no, construct_id limit 1000",
    "f12_strategy_ranking": "select id, strategy, row_number() over (partition by id order by score desc, strategy) as place from (select p_partkey as id, 'extract_function' as strategy, 70 - p_size as score from part union all select p_partkey, 'extract_class', 30 + p_size from part union all select p_partkey, 'inline', 40 from part) t",
    "g04_parameter_difference": f"select id, array_length_(array_both_(actual, doc)) as shared, array_length_(actual) + array_length_(doc) - 2 * array_length_(array_both_(actual, doc)) as different from {_PARAMS} p",
    "g07_unique_in_order": "select file, min(construct_id) as first_id from code_ c group by file",
    "h04_normalise": f"select construct_id, count(*) as kept, cast(sum(length(trim(regexp_replace(line, ' *#.*$', '')))) as bigint) as size from code_lines_ c where trim(line) <> '' and not matches_(line, r'^\\s*(#|//)') group by construct_id",
    "h05_strip_hash_comment": "select construct_id, line_no, case when (length(split_part(line, '#', 1)) - length(replace(split_part(line, '#', 1), '\"', ''))) % 2 = 0 then split_part(line, '#', 1) else line end as line from code_lines_ c where position('#' in line) > 0",
    "h06_strip_slash_comment": "select construct_id, line_no, regexp_replace(line, r'\\s*//.*$', '') as line from code_lines_ c where position('//' in line) > 0",
    "h07_indent": f"select construct_id, line_no, repeat('    ', cast(floor({_INDENT} / case when {_INDENT} % 4 = 0 then 4 else 2 end) as int)) || trim(line) as line from code_lines_ c where trim(line) <> ''",
    "h08_precise_normaliser": f"select construct_id, line_no, repeat(' ', cast(least(4, {_INDENT}) as int)) || trim(line) as line from code_lines_ c where trim(line) <> ''",
    "h18_call_signature": f"select construct_id, case when array_length_(calls) = 0 then '0000' else upper(substring(hash_(array_text_(slice_(calls, 1, 10), ',')), 1, 4)) end as signature from (select construct_id, {_CALLS} as calls from code_ c) t",
    "h19_nesting_estimate": f"select construct_id, max(cast(floor({_INDENT} / case when {_INDENT} % 4 = 0 then 4 else 2 end) as int)) as depth from code_lines_ c where trim(line) <> '' group by construct_id",
    "h29_generic_surface": "select construct_id, count(*) as kept from code_lines_ c where matches_(line, r'^\\s*(def|class|func|function|fn|pub|public|export|interface|struct|type|enum) ') group by construct_id",
    "h36_route_parameters": "select id, array_text_(regexp_extract_all(route, r'[:{<](?:[a-z]+:)?([a-z_]+)[}>]?', 1), ',') as params from (select p_partkey as id, case p_partkey % 3 when 0 then '/users/:id/posts/:post_id' when 1 then '/items/{item_id}' else '/orders/<int:order_id>/x' end as route from part) t",
    "h38_convert_lines": "select construct_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, r'\\bprint\\(', 'console.log('), r'\\band\\b', '&&'), r'^(\\s*)def ', 'function ') as line from code_lines_ c",
    "h47_risky_calls": "select construct_id, array_text_(array_sorted_(array_unique_(regexp_extract_all(text, r'\\b(eval|exec|open|system)\\s*\\(', 1))), ',') as risky from code_ c",
    "i02_complexity_score": "select construct_id, round(greatest(0, 100 - (c - 1) * cast(16.67 as double)) * cast(0.2 as double), 6) as score from (select construct_id, 1 + array_length_(regexp_extract_all(text, '(if |for |while )', 0)) as c from code_ x) t",
    "i04_effort_score": "select name, round(greatest(0, 100 - (count(*) * 5 + count(distinct file) * 10)) * cast(0.15 as double), 6) as score from code_ c group by name",
    "i25_cache_key": "select construct_id, substring(sha2(lang || '|' || file || '|' || name, 256), 1, 16) as cache_key from code_ c",
    "i26_rule_id": "select construct_id, 'rule-' || substring(sha2(text, 256), 1, 8) as rule_id from code_ c",
    "j15_varying_literals": f"select a, b, array_text_(array_filter_(array_map_(numbers_(1, greatest(1, array_length_(x), array_length_(y))), i -> case when slice_(x, i, 1) <> slice_(y, i, 1) then array_text_(slice_(x, i, 1), '') || '>' || array_text_(slice_(y, i, 1), '') end), v -> v is not null), ',') as varying from (select a, b, regexp_extract_all(old_text, {_NUMBERS}, 0) as x, regexp_extract_all(new_text, {_NUMBERS}, 0) as y from {_PAIRS} p) t",
    "j16_varying_names": f"select a, b, array_text_(array_sorted_(array_unique_(array_filter_(x, v -> not array_has_(y, v)))), ',') as only_old, array_text_(array_sorted_(array_unique_(array_filter_(y, v -> not array_has_(x, v)))), ',') as only_new from (select a, b, regexp_extract_all(old_text, {_NAMES}, 0) as x, regexp_extract_all(new_text, {_NAMES}, 0) as y from {_PAIRS} p) t",
    "j17_varying_conditions": f"select a, b, regexp_extract(old_text, 'if ([^:]*):', 1) as old_condition, regexp_extract(new_text, 'if ([^:]*):', 1) as new_condition from {_PAIRS} p where regexp_extract(old_text, 'if ([^:]*):', 1) <> regexp_extract(new_text, 'if ([^:]*):', 1)",
    # Removing lines and the blank lines that follow one another: a fix that deletes what matches.
    "l06_removal_fix": "select construct_id, line_no, line from (select construct_id, line_no, line, lag(line) over (partition by construct_id order by line_no) as before from code_lines_ c where not matches_(line, r'^\\s*(var |console[.]log)')) t where not (trim(line) = '' and coalesce(trim(before), 'x') = '')",
    "l07_splice": "select construct_id, line_no, regexp_extract(line, '^ *', 0) || 'log(i)' as line from code_lines_ c where matches_(line, r'^\\s*print\\(')",
    # Only the first loose comparison of a line is changed, none where it is one with null.
    "l09_equality_fix": f"select construct_id, line_no, case when matches_(line, {_NULL_EQUALITY}) then line when position(' == ' in line) > 0 then substring(line, 1, position(' == ' in line) - 1) || ' === ' || substring(line, position(' == ' in line) + 4) when position(' != ' in line) > 0 then substring(line, 1, position(' != ' in line) - 1) || ' !== ' || substring(line, position(' != ' in line) + 4) else line end as line from {_LOOSE} l",
    "l12_rename": "select construct_id, line_no, regexp_replace(line, r'\\bhelper_3\\b', 'assist') as line from code_lines_ c where matches_(line, r'\\bhelper_3\\b')",
    "l13_references": f"select construct_id, file, line_no, kind from {_REFERENCES} r",
    "l15_risks": f"select count(*) as changes, count(distinct file) as files, case when count(distinct file) > 10 or count(*) > 50 then 'high' when count(*) > 10 then 'medium' else 'low' end as risk from {_REFERENCES} r",
    "l19_parameter_types": "select construct_id, case when matches_(name, '^(is_|has_|can_)') then 'bool' when matches_(name, '(_count|_id|_num)$') then 'int' when matches_(name, '(_name|_path|^to_)') then 'str' else 'Any' end as type from code_ c",
}
# SHA-256 and the list functions of the other engine.
ORACLE_WORDS = [("sha2(", "sha256("), (", 256)", ")")]
