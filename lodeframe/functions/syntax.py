"""What needs a parser or a sequence matcher: Arrow-batched functions of texts.

Null texts give null, or an empty list; texts that do not parse give empty lists.
"""

from __future__ import annotations

import ast
import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIRS = {")": "(", "]": "[", "}": "{"}


def _rows(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields.items()]))


# Types as objects: text could only be read with a session.
_INT, _STRING = T.IntegerType(), T.StringType()
SIGNATURE = _rows(name=_STRING, start=_INT, end=_INT, params=T.ArrayType(_STRING), decorators=T.ArrayType(_STRING))
NODE = _rows(node=_INT, parent=_INT, kind=_STRING, line=_INT, last=_INT, depth=_INT)
PLACED = _rows(node=_INT, parent=_INT, place=_INT, path=T.ArrayType(_INT), kind=_STRING, line=_INT, text=_STRING)
EDIT = _rows(kind=_STRING, old_start=_INT, old_end=_INT, new_start=_INT, new_end=_INT)


def _parsed(text: str | None) -> ast.AST | None:
    try:
        return ast.parse(text) if text else None
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def balance_error(text: str) -> str | None:
    """The first bracket that does not fit, outside of quotes, or those left open."""
    open_, quote, skip = [], "", False
    for line_no, line in enumerate(text.split("\n"), 1):
        # Quotes end with their line, but for those of templates.
        quote = quote if quote == "`" else ""
        for c in line:
            if skip:
                skip = False
            elif quote:
                skip = c == "\\"
                quote = "" if c == quote else quote
            elif c in "\"'`":
                quote = c
            elif c in PAIRS.values():
                open_.append(c)
            elif c in PAIRS:
                if not open_ or open_.pop() != PAIRS[c]:
                    return f"unexpected {c} in line {line_no}"
    return f"unclosed {open_[-1]}" if open_ else None


def syntax_error(text: str, language: str | None) -> str | None:
    if language != "python":
        return balance_error(text)
    try:
        ast.parse(text)
    except SyntaxError as e:
        return f"{e.msg} in line {e.lineno}"
    except (ValueError, RecursionError, MemoryError) as e:
        return type(e).__name__
    return None


@F.pandas_udf(_STRING)
def syntax_errors(text: pd.Series, language: pd.Series) -> pd.Series:
    """What is wrong with the syntax of a text; null if nothing is."""
    return pd.Series([None if t is None else syntax_error(t, x) for t, x in zip(text, language)], dtype=object)


@F.pandas_udf(SIGNATURE)
def signatures(text: pd.Series) -> pd.Series:
    """The functions of a Python text, by line."""

    def of(tree: ast.AST | None) -> list[dict]:
        found = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] if tree else []
        return [
            {"name": n.name, "start": n.lineno, "end": n.end_lineno, "params": [a.arg for a in (*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs)], "decorators": [ast.unparse(d) for d in n.decorator_list]}
            for n in sorted(found, key=lambda n: (n.lineno, n.col_offset))
        ]

    return pd.Series([of(_parsed(t)) for t in text], dtype=object)


@F.pandas_udf(NODE)
def tree(text: pd.Series) -> pd.Series:
    """The syntax tree of a Python text as rows: ``node`` counts in pre-order, ``last`` is the last node below it."""

    def of(root: ast.AST | None) -> list[dict]:
        rows: list[dict] = []
        todo: list[tuple[ast.AST | None, int]] = [(root, -1)] if root else []
        while todo:
            node, parent = todo.pop()
            if node is None:
                rows[parent]["last"] = len(rows) - 1
                continue
            at = len(rows)
            rows.append({"node": at, "parent": parent, "kind": type(node).__name__, "line": getattr(node, "lineno", 0), "last": at, "depth": rows[parent]["depth"] + 1 if parent >= 0 else 0})
            todo.append((None, at))
            todo.extend((c, at) for c in reversed(list(ast.iter_child_nodes(node))))
        return rows

    return pd.Series([of(_parsed(t)) for t in text], dtype=object)


@F.pandas_udf(PLACED)
def nodes(text: pd.Series) -> pd.Series:
    """The nodes of a Python text's tree in pre-order, with their place among siblings, the nodes around them and their source."""

    def of(t: str | None) -> list[dict]:
        root, rows = _parsed(t), []
        if root is None:
            return rows
        lines = t.encode().splitlines(keepends=True)

        def source(node: ast.AST) -> str:
            if not hasattr(node, "end_lineno"):
                return ast.unparse(node) if isinstance(node, ast.arguments) else ""
            first, last = node.lineno - 1, node.end_lineno - 1
            if first == last:
                return lines[first][node.col_offset : node.end_col_offset].decode()
            return b"".join([lines[first][node.col_offset :], *lines[first + 1 : last], lines[last][: node.end_col_offset]]).decode()

        todo = [(root, [], 0)]
        while todo:
            node, path, place = todo.pop()
            at = len(rows)
            rows.append({"node": at, "parent": path[-1] if path else -1, "place": place, "path": path, "kind": type(node).__name__, "line": getattr(node, "lineno", 0), "text": source(node)})
            children = list(enumerate(ast.iter_child_nodes(node)))
            todo.extend((c, [*path, at], i) for i, c in reversed(children))
        return rows

    return pd.Series([of(t) for t in text], dtype=object)


def inside(nodes: Column, kind: str, outer: str) -> Column:
    """The nodes of a kind that have an ancestor of another; an ancestor is an interval of pre-order that holds the node.

    ``nodes`` is a column of rows that hold a tree, not a call of ``tree`` itself.
    """
    outers = F.filter(nodes, lambda n: n["kind"] == outer)
    return F.filter(nodes, lambda n: (n["kind"] == kind) & F.exists(outers, lambda o: (o["node"] < n["node"]) & (n["node"] <= o["last"])))


@F.pandas_udf(T.DoubleType())
def line_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching text of two snippets whose lines are trimmed and not blank."""

    def plain(t: str) -> str:
        return "\n".join(x.strip() for x in t.split("\n") if x.strip())

    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, plain(x), plain(y)).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(EDIT)
def line_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """The edits that turn the lines of one text into those of the other."""

    def of(x: str | None, y: str | None) -> list[dict]:
        codes = difflib.SequenceMatcher(None, (x or "").split("\n"), (y or "").split("\n"), autojunk=False).get_opcodes()
        return [{"kind": k, "old_start": i, "old_end": j, "new_start": m, "new_end": n} for k, i, j, m, n in codes]

    return pd.Series([of(x, y) for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(_STRING)
def unified_diff(a: pd.Series, b: pd.Series, file: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(difflib.unified_diff((x or "").split("\n"), (y or "").split("\n"), f"a/{f}", f"b/{f}", lineterm="")) for x, y, f in zip(a, b, file)], dtype=object)


@F.pandas_udf(_STRING)
def python_surface(text: pd.Series) -> pd.Series:
    """Imports, heads of classes and functions and assignments of a module, without bodies."""

    def of(t: str | None) -> str | None:
        if t is None:
            return None
        kept, within = [], None
        for line in t.split("\n"):
            bare = line.strip()
            if not bare:
                continue
            indent = len(line) - len(line.lstrip())
            if within is not None and indent > within:
                continue
            within = None
            if re.match(r"(async\s+)?def\s", bare):
                kept.append(line.rstrip() + (" ..." if bare.endswith(":") else ""))
                within = indent
            elif re.match(r"(class|import|from|@)\b|@", bare) or indent == 0 and re.match(r"[A-Za-z_]\w*\s*[:=]", bare):
                kept.append(line.rstrip())
        return "\n".join(kept)

    return pd.Series([of(t) for t in text], dtype=object)


def pattern_regex(pattern: str) -> tuple[str, list[str]]:
    """A regular expression for a code pattern, and the names of its groups.

    ``$NAME`` is one run without commas, brackets or spaces, the same at each use;
    ``$$$NAME`` any text of the line; ``$_`` any run. Spaces are any number of spaces.
    It is matched as text, so calls within a ``$NAME`` are not seen as one expression.
    """
    out, names = "", []
    for part in re.split(r"(\$\$\$[A-Z0-9_]*|\$_[A-Z0-9_]*|\$[A-Z][A-Z0-9_]*|\s+)", pattern):
        if part.startswith("$$$"):
            names.append(part[3:] or f"REST{len(names)}")
            out += "(.*?)"
        elif part.startswith("$_"):
            out += r"[^\s,()]+"
        elif part.startswith("$"):
            if part[1:] in names:
                out += f"\\{names.index(part[1:]) + 1}"
            else:
                names.append(part[1:])
                out += r"([^\s,()]+)"
        elif part.strip():
            out += re.sub(r"([.\\+*?^$()\[\]{}|])", r"\\\1", part)
        elif part:
            out += r"\s*"
    return out, names
