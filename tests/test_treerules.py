"""Rules over rows of nodes against a plain walk of the tree."""

import ast
import random
import re

import pytest

from lodeframe.functions import syntax
from lodeframe.operators import treerules

CODE = """import os
def f(a, b):
    x = a
    for i in b:
        print(i)
        while i:
            print(x)
            x = x + 1
    y = x + 1
    print(y)
    return g(a, a)
class C:
    def m(self):
        return g(self, 1)
"""
NODES = "doc long, text string"


def lines(spark, rule, texts=(CODE,), constraints=None):
    nodes = treerules.tree_nodes(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], NODES))
    return sorted((r.doc, r.line) for r in treerules.find_by_rule(nodes, rule, constraints).collect())


def test_relations(spark):
    call = {"kind": "Call", "pattern": "print($A)"}
    assert lines(spark, call) == [(0, 5), (0, 7), (0, 10)]
    assert lines(spark, {**call, "inside": {"kind": "For", "stopBy": "end"}}) == [(0, 5), (0, 7)]
    assert lines(spark, {**call, "inside": {"kind": "For"}}) == []
    assert lines(spark, {"kind": "Expr", "inside": {"kind": "For"}}) == [(0, 5)]
    assert lines(spark, {**call, "not": {"inside": {"kind": "While", "stopBy": "end"}}}) == [(0, 5), (0, 10)]
    assert lines(spark, {"kind": "For", "has": {"kind": "BinOp", "stopBy": "end"}}) == [(0, 4)]
    assert lines(spark, {"kind": "For", "has": {"kind": "While"}}) == [(0, 4)]
    assert lines(spark, {"kind": "For", "has": {"kind": "BinOp"}}) == []
    assert lines(spark, {"kind": "Return", "follows": {"kind": "For", "stopBy": "end"}}) == [(0, 11)]
    assert lines(spark, {"kind": "Return", "follows": {"kind": "For"}}) == []
    assert lines(spark, {"kind": "Assign", "precedes": {"kind": "For"}}) == [(0, 3)]
    assert lines(spark, {"kind": "Assign", "precedes": {"kind": "Return", "stopBy": "end"}}) == [(0, 3), (0, 9)]
    assert lines(spark, {"any": [{"kind": "While"}, {"kind": "For"}]}) == [(0, 4), (0, 6)]
    assert lines(spark, {"all": [{"kind": "Assign"}, {"regex": "1$"}], "not": {"regex": "^y"}}) == [(0, 8)]


def test_variables_are_equal_wherever_they_occur(spark):
    assert lines(spark, {"kind": "Call", "pattern": "g($A, $A)"}) == [(0, 11)]
    assert lines(spark, {"kind": "Assign", "pattern": "$V = $W", "precedes": {"kind": "Expr", "has": {"pattern": "print($V)"}}}) == []
    assert lines(spark, {"kind": "Assign", "pattern": "$V = $$$W", "precedes": {"kind": "Expr", "has": {"kind": "Call", "pattern": "print($V)"}}}) == [(0, 9)]
    assert lines(spark, {"all": [{"kind": "Assign", "pattern": "$V = $$$W"}, {"pattern": "$V = $V + 1"}]}) == [(0, 8)]
    assert lines(spark, {"kind": "Call", "pattern": "print($A)"}, constraints={"A": "^[xy]$"}) == [(0, 7), (0, 10)]


def test_odd_texts(spark):
    assert lines(spark, {"kind": "Name"}, [None, "", "def (", "a", "é = 'ü'"]) == [(3, 1), (4, 1)]
    nodes = treerules.tree_nodes(spark.createDataFrame([(1, "é = 'ü' + b")], NODES))
    assert {r.text for r in nodes.collect()} >= {"é", "'ü'", "b", "é = 'ü' + b"}


@pytest.mark.parametrize("rule", ["x", {}, {"inside": {"kind": "For"}}, {"kind": "For", "what": 1}, {"kind": "For", "has": {"kind": "If", "stopBy": {"kind": "Def"}}}, {"all": []}, {"kind": "For", "not": {"inside": {"stopBy": "end"}}}])
def test_rules_that_cannot_match(rule):
    with pytest.raises(ValueError):
        treerules.check(rule)


def test_against_a_plain_walk(spark):
    r = random.Random(2)
    kinds = ["For", "While", "If", "Assign", "Expr", "Call", "Name", "Return", "FunctionDef", "BinOp"]
    all_nodes, parent, place = [], {}, {}

    def walk(node):
        all_nodes.append(node)
        for i, child in enumerate(ast.iter_child_nodes(node)):
            parent[child], place[child] = node, i
            walk(child)

    walk(ast.parse(CODE))

    def around(n):
        while n in parent:
            n = parent[n]
            yield n

    def plain(n, rule):
        k = lambda m: type(m).__name__ == rule["other"]
        siblings = [m for m in all_nodes if parent.get(m) is parent.get(n) and m in parent]
        near = rule["stop"] == "neighbor"
        return {
            "inside": any(k(m) for m in ([parent[n]] if n in parent else []) if near) or not near and any(map(k, around(n))),
            "has": any(k(m) for m in all_nodes if (parent.get(m) is n if near else n in around(m))),
            "follows": any(k(m) for m in siblings if (place[m] == place[n] - 1 if near else place[m] < place[n])),
            "precedes": any(k(m) for m in siblings if (place[m] == place[n] + 1 if near else place[m] > place[n])),
        }[rule["relation"]]

    nodes = treerules.tree_nodes(spark.createDataFrame([(0, CODE)], NODES)).cache()
    for _ in range(16):
        rule = {"kind": r.choice(kinds), "other": r.choice(kinds), "relation": r.choice(treerules.RELATIONS), "stop": r.choice(["end", "neighbor"])}
        want = sorted(n.lineno for n in all_nodes if type(n).__name__ == rule["kind"] and n in parent and plain(n, rule))
        got = treerules.find_by_rule(nodes, {"kind": rule["kind"], rule["relation"]: {"kind": rule["other"], "stopBy": rule["stop"]}}).collect()
        assert sorted(x.line for x in got) == want, rule


def test_patterns_are_matched_whole():
    expression, names = syntax.pattern_regex("print($A)")
    assert names == ["A"] and re.fullmatch(expression, "print(x)") and not re.fullmatch(expression, "print(f(x))")
