"""Expressions to values over a relation."""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.errors import ScriptError
from ..plans.expr import Node
from ..plans.relation import Relation
from .patterns import jvm_pattern
from .values import MATH, Value, extreme, ieee, power, trimmed

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge,
}


@dataclass
class Scope:
    """What an expression reads: columns, the row before, the row's number."""

    relation: Relation
    previous: dict[int, str] = field(default_factory=dict)  # position: physical column of the row before
    first: str | None = None  # physical boolean: the first row
    number: str | None = None  # physical count of the row, from 1


def static_type(scope: Scope, node: Node) -> str | None:
    k = node.kind
    if k in ("num", "neg") or (k == "bin" and node.value != "++"):
        return "Num"
    if k in ("str", "bin", "cmp", "match", "and", "or", "not"):
        return "Str"
    if k == "word":
        return None if node.value in scope.relation.header else "Num"
    if k == "col":
        return scope.relation.get(node.value).static
    if k == "if":
        a, b = static_type(scope, node.args[1]), static_type(scope, node.args[2])
        return a if a == b else None
    if node.value == "prev":
        return static_type(scope, node.args[0])
    if node.value in ("upper", "lower", "trim", "str"):
        return "Str"
    return None if node.value == "coalesce" else "Num"


def reads_prev(node: Node) -> bool:
    """Whether the value of an operand can come from the row before."""
    if node.kind == "func" and node.value == "prev":
        return True
    if node.kind == "if":
        return any(reads_prev(a) for a in node.args[1:])
    if node.kind in ("neg", "bin", "func"):
        return any(reads_prev(a) for a in node.args)
    return False


def evaluate(scope: Scope, node: Node) -> Value:
    k = node.kind
    if k == "num":
        return Value("num", F.lit(node.value), "Num")
    if k == "str":
        return Value("text", F.lit(node.value), "Str")
    if k == "word":
        if node.value in scope.relation.header:
            raise ScriptError(f"'{node.value}' is a number here and also a column; write the column in backticks")
        return Value("num", F.lit(float(node.value)), "Num")
    if k == "col":
        return scope.relation.get(node.value).value()
    if k == "neg":
        return Value("num", -evaluate(scope, node.args[0]).number(), "Num")
    if k == "bin":
        left, right = (evaluate(scope, a) for a in node.args)
        if node.value == "++":
            return Value("text", F.concat(left.text(), right.text()), "Str")
        x, y = left.number(), right.number()
        if node.value in "/%":
            zero = F.raise_error(F.lit("stopped by a division by zero")).cast("double")
            safe = F.when(y == 0, zero).otherwise(y)
            return Value("num", x / safe if node.value == "/" else x % safe, "Num")
        return Value("num", {"+": operator.add, "-": operator.sub, "*": operator.mul}[node.value](x, y), "Num")
    if k == "if":
        test = condition(scope, node.args[0])
        a, b = (evaluate(scope, x) for x in node.args[1:])
        static = a.static if a.static == b.static else None
        numeric = {"num", "int"}
        if a.kind in numeric and b.kind in numeric:
            return Value("num", F.when(test, a.optional()).otherwise(b.optional()), static)
        if a.kind not in numeric | {"mixed"} and b.kind not in numeric | {"mixed"}:
            return Value("text", F.when(test, a.text()).otherwise(b.text()), static)
        return Value("mixed", F.when(test, a.as_mixed().column).otherwise(b.as_mixed().column), static)
    if k == "func":
        return call(scope, node)
    return Value("text", F.when(condition(scope, node), "t").otherwise("f"), "Str")


def call(scope: Scope, node: Node) -> Value:
    name = node.value
    if name == "rownum":
        return Value("num", F.col(scope.number).cast("double"), "Num")
    if name == "prev":
        at = scope.relation.position(node.args[0].value)
        own = scope.relation.fields[at]
        return Value(own.kind, F.col(scope.previous[at]), own.static)
    args = [evaluate(scope, a) for a in node.args]
    if name in MATH:
        return Value("num", MATH[name](args[0].number()), "Num")
    if name == "pow":
        return Value("num", power(args[0].number(), args[1].number()), "Num")
    if name in ("min", "max"):
        return Value("num", extreme([a.number() for a in args], name == "max"), "Num")
    if name == "num":
        return Value("num", args[0].number(), "Num")
    if name == "len":
        return Value("num", F.length(args[0].text()).cast("double"), "Num")
    if name == "coalesce":
        if all(a.kind in ("text", "time", "bool") for a in args):
            return Value("text", _first_text([(a.text(), a.text()) for a in args], F.lit("")))
        last = Value("text", F.lit("")).as_mixed().column
        return Value("mixed", _first_text([(a.text(), a.as_mixed().column) for a in args], last))
    text = args[0].text()
    done = {"upper": F.upper, "lower": F.lower, "trim": trimmed, "str": lambda t: t}[name](text)
    return Value("text", done, "Str")


def _first_text(pairs: list[tuple[Column, Column]], last: Column) -> Column:
    out = last
    for text, value in reversed(pairs):
        out = F.when(text != "", value).otherwise(out)
    return out


def condition(scope: Scope, node: Node) -> Column:
    k = node.kind
    if k == "not":
        return ~condition(scope, node.args[0])
    if k == "and":  # nested, so that the second side is not evaluated where the first decides
        a, b = (condition(scope, x) for x in node.args)
        return F.when(a, b).otherwise(F.lit(False)) if can_fail(scope, node.args[1]) else a & b
    if k == "or":
        a, b = (condition(scope, x) for x in node.args)
        return F.when(a, F.lit(True)).otherwise(b) if can_fail(scope, node.args[1]) else a | b
    if k == "if":
        test, a, b = (condition(scope, x) for x in node.args)
        return F.when(test, a).otherwise(b)
    found = _match(scope, node) if k == "match" else _compare(scope, node)
    if any(reads_prev(a) for a in node.args):
        return found & ~F.col(scope.first)
    return found


def can_fail(scope: Scope, node: Node) -> bool:
    """Whether evaluating the node may stop the run."""
    if node.kind == "bin" and node.value in "/%":
        return True
    if node.kind in ("cmp", "bin", "neg", "func") and any(
        a.kind == "col" and scope.relation.get(a.value).kind in ("text", "mixed") for a in node.args
    ):
        return node.kind != "cmp" or "Num" in [static_type(scope, a) for a in node.args]
    return any(can_fail(scope, a) for a in node.args)


def _match(scope: Scope, node: Node) -> Column:
    text, pattern = evaluate(scope, node.args[0]).text(), node.args[1].value
    op = node.value
    if op in ("=~", "!~"):
        found = text.rlike(jvm_pattern(pattern))
        return found if op == "=~" else ~found
    return {"^=": text.startswith, "*=": text.contains, "$=": text.endswith}[op](pattern)


def comparison_mode(scope: Scope, node: Node) -> str:
    """How a comparison reads its sides: ``numeric``, ``text``, or ``auto`` (row by row)."""
    types = [static_type(scope, a) for a in node.args]
    if "Num" in types:
        return "numeric"
    return "text" if "Str" in types or node.value in ("==", "!=") else "auto"


def _compare(scope: Scope, node: Node) -> Column:
    op, (a, b) = node.value, node.args
    left, right, compare = evaluate(scope, a), evaluate(scope, b), _COMPARE[op]
    mode = comparison_mode(scope, node)
    if mode == "numeric":
        for side in (a, b):
            if side.kind == "str" and not _reads_as_number(side.value):
                raise ScriptError(f"'{side.value}' is compared with a number and is none")
        if left.kind in ("num", "int") and a.kind == "col" and b.kind in ("num", "str"):
            return _against_literal(op, left, float(b.value if b.kind == "num" else b.value.strip() or "0"))
        sides = [_literal_number(v, n) for v, n in ((left, a), (right, b))]
        return _numeric(op, *sides)
    if mode == "text":
        if left.kind == right.kind == "int" and op in ("==", "!="):
            same = left.column.eqNullSafe(right.column)
            return same if op == "==" else ~same
        return compare(left.text(), right.text())
    x, y = left.soft(), right.soft()
    if left.kind in ("num", "int") and right.kind in ("num", "int"):
        return ieee(compare, x, y)
    return F.when(x.isNotNull() & y.isNotNull(), ieee(compare, x, y)).otherwise(compare(left.text(), right.text()))


def _reads_as_number(text: str) -> bool:
    try:
        float(text.strip() or "0")
    except ValueError:
        return False
    return "_" not in text


def _literal_number(value: Value, node: Node) -> Value:
    if node.kind == "str":
        return Value("num", F.lit(float(node.value.strip() or "0")), "Num")
    return value


def _against_literal(op: str, value: Value, literal: float) -> Column:
    """A stored number against a literal, in a form that Parquet filters take.

    A blank reads as 0 and NaN compares with nothing.
    """
    same = literal == literal and abs(literal) < 2**53 and literal == int(literal)
    if not same and value.kind == "int":
        return _numeric(op, value, Value("num", F.lit(literal)))
    column = value.column
    found = _COMPARE[op](column, F.lit(int(literal)) if value.kind == "int" else F.lit(literal))
    if value.kind == "num":
        found = (found | F.isnan(column)) if op == "!=" else (found & ~F.isnan(column))
    if _COMPARE[op](0.0, literal):
        return found | column.isNull()
    return found & column.isNotNull()


def _numeric(op: str, left: Value, right: Value) -> Column:
    """Numeric comparison: with NaN, which integers have not, nothing holds but '!='."""
    x, y = left.number(), right.number()
    nan = [F.isnan(c) for v, c in ((left, x), (right, y)) if v.kind != "int"]
    if not nan:
        return _COMPARE[op](x, y)
    either = nan[0] if len(nan) == 1 else nan[0] | nan[1]
    return F.when(either, F.lit(op == "!=")).otherwise(_COMPARE[op](x, y))
