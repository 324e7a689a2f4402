"""Search of syntax trees by rules, as joins over rows of nodes.

A rule is a dictionary. ``kind``, ``regex`` and ``pattern`` say what a node is; ``all``, ``any`` and ``not`` combine
rules; ``inside``, ``has``, ``follows`` and ``precedes`` hold a rule for a node around, below, before or after it, with ``stopBy`` `end` (any
such node) or `neighbor` (the next one alone, the default). Several keys must all hold. Variables of patterns (`$A`) are columns: wherever a
variable occurs again it must have the same text. What ``any`` binds are the variables that all its rules bind; ``not`` binds none.

Nodes carry the numbers of the nodes around them, so that relations are joins on equal numbers, never on intervals: `inside` looks its
own ancestors up, `has` those of what it holds. No pairs of a document's nodes are made but those of nodes that match with their ancestors, or with the first or last match among
their siblings. Texts that are null, empty or no Python have no nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import syntax
from lodeframe.operators.search import _code
from lodeframe.plans import dialect
from lodeframe.session import spread, written

NODE = ["doc", "node", "parent", "place", "path"]
ATOMIC, RELATIONS = {"kind", "regex", "pattern"}, ("inside", "has", "follows", "precedes")
KEYS = {*ATOMIC, "all", "any", "not", *RELATIONS}


def tree_nodes(code: DataFrame) -> DataFrame:
    """doc, node, parent, place (among siblings), path (of the nodes around it), kind, line, text of the nodes of rows (doc, text)."""
    return code.select("doc", F.explode(syntax.nodes("text")).alias("n")).select("doc", "n.*")


def check(rule: dict, stops: bool = False) -> None:
    """Raise ValueError for a rule that no node can be matched against."""
    if not isinstance(rule, dict):
        raise ValueError(f"a rule is a dictionary, not {rule!r}")
    unknown = set(rule) - KEYS - ({"stopBy"} if stops else set())
    if unknown:
        raise ValueError(f"unknown in a rule: {', '.join(sorted(unknown))}")
    if rule.get("stopBy", "neighbor") not in ("end", "neighbor"):
        raise ValueError("stopBy is `end` or `neighbor`")
    if not set(rule) & {*ATOMIC, "all", "any"}:
        raise ValueError("a rule says what a node is: kind, regex, pattern, all or any")
    for key in ("all", "any"):
        if key in rule and not rule[key]:
            raise ValueError(f"{key} has no rules")
        for part in rule.get(key, []):
            check(part)
    if "not" in rule:
        # What is excluded may be a relation alone: it is held against the nodes that match the rest.
        check({"kind": "", **rule["not"]} if set(rule["not"]) & set(RELATIONS) else rule["not"])
    for key in RELATIONS:
        if key in rule:
            check(rule[key], True)


def _variables(found: DataFrame) -> list[str]:
    return [c for c in found.columns if c not in NODE]


def _met(found: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``found`` where ``other`` has a row with equal ``on`` and equal variables, with the variables that are new."""
    other = other.drop(*[c for c in NODE if c not in on])
    shared = [v for v in _variables(found) if v in other.columns]
    return found.join(other.hint("shuffle_merge"), [*on, *shared], how).select(*found.columns, *[c for c in other.columns if how == "inner" and c not in (*found.columns, *on)])


def _atoms(nodes: DataFrame, rule: dict) -> DataFrame:
    found, names = nodes, []
    if "kind" in rule:
        found = found.filter(F.col("kind") == rule["kind"])
    if "regex" in rule:
        found = found.filter(F.col("text").rlike(rule["regex"]))
    if "pattern" in rule:
        expression, names = syntax.pattern_regex(rule["pattern"])
        whole = f"(?s)^{expression}$"
        found = found.filter(F.col("text").rlike(whole))
        found = found.withColumns({name: F.regexp_extract("text", whole, i + 1) for i, name in enumerate(names)})
    return found.select(*NODE, *names)


def _related(nodes: DataFrame, found: DataFrame, relation: str, rule: dict) -> DataFrame:
    other = _match(nodes, {k: v for k, v in rule.items() if k != "stopBy"})
    far, own = rule.get("stopBy", "neighbor") == "end", _variables(other)
    if relation == "inside":
        around = other.select("doc", F.col("node").alias("around"), *own)
        outer = F.explode("path") if far else F.col("parent")
        return _met(found.select("*", outer.alias("around")), around, ["doc", "around"]).drop("around").distinct()
    if relation == "has":
        around = F.explode("path") if far else F.col("parent")
        return _met(found, other.select("doc", around.alias("node"), *own).distinct(), ["doc", "node"]).distinct()
    if not far:
        beside = F.col("place") + (1 if relation == "follows" else -1)
        return _met(found, other.select("doc", "parent", beside.alias("place"), *own).distinct(), ["doc", "parent", "place"]).distinct()
    first = F.min("place") if relation == "follows" else F.max("place")
    other = other.groupBy("doc", "parent", *own).agg(first.alias("reach"))
    late = F.col("reach") < F.col("place") if relation == "follows" else F.col("reach") > F.col("place")
    return _met(found, other, ["doc", "parent"]).filter(late).drop("reach").distinct()


def _match(nodes: DataFrame, rule: dict) -> DataFrame:
    found = _atoms(nodes, rule) if set(rule) & ATOMIC else None
    for part in rule.get("all", []):
        other = _match(nodes, part)
        found = other if found is None else _met(found, other, ["doc", "node"]).distinct()
    if "any" in rule:
        parts = [_match(nodes, part) for part in rule["any"]]
        common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
        other = reduce(lambda a, b: a.unionByName(b), [p.select(*common) for p in parts]).distinct()
        found = other if found is None else _met(found, other, ["doc", "node"]).distinct()
    for relation in RELATIONS:
        if relation in rule:
            found = _related(nodes, found, relation, rule[relation])
    if "not" in rule:
        out = found
        for key in (k for k in rule["not"] if k in RELATIONS):
            out = _related(nodes, out, key, rule["not"][key])
        rest = {k: v for k, v in rule["not"].items() if k not in RELATIONS}
        if rest:
            out = _met(out, _match(nodes, rest), ["doc", "node"])
        found = _met(found, out.select("doc", "node", *_variables(found)).distinct(), ["doc", "node"], "left_anti")
    return found


def find_by_rule(nodes: DataFrame, rule: dict, constraints: dict[str, str] | None = None) -> DataFrame:
    """doc, node, line, text, variables (a map) of the ``nodes`` (of ``tree_nodes``) that match; ``constraints`` are expressions for variables.

    A node that matches with several values of its variables is there with each.
    """
    check(rule)
    found = _match(nodes, rule)
    names = _variables(found)
    for name, expression in (constraints or {}).items():
        if name not in names:
            raise ValueError(f"no variable {name}")
        found = found.filter(F.col(name).rlike(expression))
    variables = F.map_from_arrays(F.array(*[F.lit(n) for n in names]).cast("array<string>"), F.array(*[F.col(n) for n in names]).cast("array<string>"))
    said = nodes.select("doc", "node", "line", "text")
    return found.select("doc", "node", variables.alias("variables")).join(said.hint("shuffle_merge"), ["doc", "node"]).select("doc", "node", "line", "text", "variables")


#: Rules of the query, of each kind.
RULES = {
    "prints_in_loop": {"pattern": "print($A)", "kind": "Call", "inside": {"kind": "For", "stopBy": "end"}, "not": {"inside": {"kind": "While", "stopBy": "end"}}},
    "while_that_prints": {"kind": "While", "has": {"pattern": "print($X)", "kind": "Call", "stopBy": "end"}},
    "assigned_after_if": {"kind": "Assign", "pattern": "y = $$$V", "follows": {"kind": "If", "stopBy": "end"}},
    "if_before_return": {"kind": "If", "precedes": {"kind": "Return", "stopBy": "end"}},
    "return_after_assignment": {"kind": "Return", "follows": {"kind": "Assign"}},
    "counts_up": {"all": [{"kind": "Assign"}, {"pattern": "$V = $V + 1"}]},
    "loops_or_eval": {"any": [{"kind": "While"}, {"kind": "Call", "pattern": "eval($A)"}]},
    "compares_parameter": {"kind": "Compare", "pattern": "$P > $N", "inside": {"kind": "FunctionDef", "has": {"kind": "arguments", "regex": "\\ba\\b"}, "stopBy": "end"}},
}


def code_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, id, line, bound of what the rules find in the Python functions of the code corpus."""
    # Parsing takes far longer than ``part`` is large. Neither a checkpoint nor a table, which packs well, says how large nodes are: joins are told not to broadcast them.
    nodes = written(tree_nodes(spread(_code(spark, sf_dir).filter("lang = 'python'").select(F.col("id").alias("doc"), "text"))))
    parts = []
    for name, rule in RULES.items():
        bound = F.array_join(F.transform(F.array_sort(F.map_entries("variables")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
        parts.append(find_by_rule(nodes, rule).select(F.lit(name).alias("rule"), F.col("doc").alias("id"), "line", bound.alias("bound")))
    return reduce(lambda a, b: a.unionByName(b), parts)


FRAMES = {"l38_code_by_rule": code_by_rule}

#: By lines: functions are Python exactly if no parameter without a default follows the one that has one, and no other language's words are in them.
_WORDS = {
    "prints_in_loop": ("'A=i'", "trim(line) = 'print(i)' and construct_id % 4 <> 0"),
    "while_that_prints": ("'X=i'", "trim(line) = 'while b:'"),
    "assigned_after_if": ("'V=' || substr(line, 9)", "line like '    y = %'"),
    "if_before_return": ("''", "line like '    if %'"),
    "return_after_assignment": ("''", "line like '    return %'"),
    "counts_up": ("'V=y'", "line = '    y = y + 1'"),
    "loops_or_eval": ("''", "(trim(line) = 'while b:' or trim(line) = 'eval(a)')"),
    "compares_parameter": ("'N=' || regexp_extract(line, 'a > ([0-9]+)', 1) || ';P=a'", "line like '    if a > %'"),
}
FRAME_ORACLES = {
    "l38_code_by_rule": dialect.duck_sql(" union all ".join(f"select '{name}' as rule, construct_id as id, line_no as line, {bound} as bound from code_lines_ c where lang = 'python' and construct_id % 7 = 0 and construct_id % 6 <> 0 and {where}" for name, (bound, where) in _WORDS.items())),
}
