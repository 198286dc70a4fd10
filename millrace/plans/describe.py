"""Resolved stages in words: positions of columns, modes of comparisons and sorts."""

from __future__ import annotations

from ..functions.evaluate import Scope, comparison_mode
from .expr import Node
from .relation import Relation
from .script import Stage

_TIGHT = {"or": 1, "and": 2, "not": 3, "cmp": 4, "match": 4}


def _column(rel: Relation, name: str) -> str:
    at = rel.position(name)
    return f"{rel.fields[at].name}#{at + 1}"


def expression(rel: Relation, node: Node) -> str:
    """The expression with each column's position and each comparison's mode."""
    parts = [expression(rel, a) for a in node.args if node.kind != "match"]
    kind = node.kind
    if kind == "num":
        return f"{node.value:g}"
    if kind == "str":
        return f"'{node.value}'"
    if kind == "word":
        return str(node.value)
    if kind == "col":
        return _column(rel, node.value)
    if kind == "neg":
        return f"-{parts[0]}"
    if kind == "not":
        return f"!{parts[0]}"
    if kind == "bin":
        return f"({parts[0]} {node.value} {parts[1]})"
    if kind in ("and", "or"):
        return f"({parts[0]} {'&&' if kind == 'and' else '||'} {parts[1]})"
    if kind == "if":
        return f"({parts[0]} ? {parts[1]} : {parts[2]})"
    if kind == "func":
        return f"{node.value}({', '.join(parts)})"
    if kind == "match":
        return f"({expression(rel, node.args[0])} {node.value} '{node.args[1].value}')"
    return f"({parts[0]} {node.value} {parts[1]} as {comparison_mode(Scope(rel), node)})"


def stage(rel: Relation, s: Stage) -> str:
    """One line for a stage, bound to the columns that enter it."""
    a, verb = s.args, s.verb
    if verb == "select":
        around = "".join(f" with {a[k]} rows {k}" for k in ("before", "after") if a[k])
        return f"select {'not ' if a['invert'] else ''}{expression(rel, a['expr'])}{around}"
    if verb == "add":
        known = a["name"] in rel.header or (a["name"].isdigit() and not a["quoted"])
        return f"add {_column(rel, a['name']) if known else a['name'] + ' (new)'} = {expression(rel, a['expr'])}"
    if verb == "sort":
        def key(name: str, mode: str, reverse: bool) -> str:
            field = rel.get(name)
            mode = mode or {"Num": "n", "Str": "s"}.get(field.static or "", "") or ("n" if field.kind in ("num", "int") else "")
            return f"{_column(rel, name)} {({'n': 'numeric', 's': 'text'}).get(mode, 'auto')}{' reverse' if reverse else ''}"

        return "sort " + ", ".join(key(*k) for k in a["keys"])
    if verb in ("uniq", "stats"):
        return f"{verb} {', '.join(_column(rel, c) for c in a['columns']) or 'all columns'}"
    if verb == "agg":
        made = [f"{name + '=' if name else ''}{fn}({_column(rel, col) if col else 'rows'})" for name, fn, col in a["aggregates"]]
        return f"agg {', '.join(made)} by {', '.join(_column(rel, k) for k in a['keys']) or 'nothing'}"
    if verb == "join":
        return f"join {a['how']} " + ", ".join(f"{f['file']} on {','.join(f['on'])}{' after its own stages' if f['sub'] else ''}" for f in a["files"])
    if verb == "rename":
        return "rename " + ", ".join(f"{_column(rel, old) if old in rel.header or old.isdigit() else old} to {new}" for old, new in a["pairs"])
    if verb == "head":
        return f"head {a['first']} rows" if "first" in a else f"head all but {a['but_last']} rows"
    if verb == "tail":
        return f"tail {a['last']} rows" if "last" in a else f"tail from row {a['from']}"
    return f"{verb} {s.text.partition(' ')[2].strip()}".rstrip()
