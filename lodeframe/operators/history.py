"""Commits: parsing, change types, changelog. ``commits_`` stands for a repository's log (see ``dialect``)."""

# Type and scope of a conventional subject, references, change types.
_SUBJECT = r"r'^(\w+)(?:\(([^)]+)\))?(!)?:\s*(.+)$'"
_ISSUES = r"r'#(\d+)'"
_PRS = r"r'(?i)(?:pull request|pr|merge request|mr)\s*#?(\d+)'"

_PARSED = f"""(select id, made_at, subject, nullif(lower(regexp_extract(subject, {_SUBJECT}, 1)), '') as type, nullif(regexp_extract(subject, {_SUBJECT}, 2), '') as scope,
  coalesce(nullif(regexp_extract(subject, {_SUBJECT}, 4), ''), subject) as said,
  regexp_extract(subject, {_SUBJECT}, 3) = '!' or position('BREAKING CHANGE' in body) > 0 or position('BREAKING-CHANGE' in body) > 0 as is_breaking,
  array_text_(array_sorted_(array_unique_(regexp_extract_all(subject || ' ' || body, {_ISSUES}, 1))), ',') as issues,
  array_text_(array_sorted_(array_unique_(regexp_extract_all(subject || ' ' || body, {_PRS}, 1))), ',') as prs from commits_ c)"""

_CHANGE = "case when type in ('feat', 'feature', 'add') then 'Added' when type in ('fix', 'bugfix', 'bug') then 'Fixed' when type in ('remove', 'removed', 'delete') then 'Removed' when type in ('deprecate', 'deprecated') then 'Deprecated' when type in ('security', 'sec') then 'Security' else 'Changed' end"

QUERIES = {
    "h31_conventional_commits": f"select id, type, scope, is_breaking, issues, prs from {_PARSED} p",
    "h32_change_types": f"select id, {_CHANGE} as change_type from {_PARSED} p",
    # Versions are months. The groups are counted, never gathered in a row.
    "d21_commits_by_change_type": f"select date_trunc('month', made_at) as version, {_CHANGE} as change_type, count(*) as n, count_if(is_breaking) as breaking, min(id) as first_id from {_PARSED} p group by 1, 2",
    # One row for each line of the changelog, in its place: no version is numbered in one task.
    "l25_changelog": f"""select version, change_type, id as place,
      '- ' || case when is_breaking then '**BREAKING** ' else '' end || coalesce('**' || scope || '**: ', '') || said as line from (select date_trunc('month', made_at) as version, {_CHANGE} as change_type, id, is_breaking, scope, said from {_PARSED} p) q""",
}
