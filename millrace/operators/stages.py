"""The verbs of the pipe language as transformations of relations."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.evaluate import Scope, can_fail, condition, evaluate
from ..functions.values import Value, formatted
from ..plans.errors import ScriptError
from ..plans.expr import Node, walk
from ..plans.relation import Field, Relation, fresh
from ..plans.script import Stage, uses
from .numbering import chunked, near_hits, number_rows, previous_values, settled, with_ordinal

def _scope(rel: Relation, node: Node, number: str | None) -> tuple[Relation, Scope]:
    """The relation with what *node* needs of the row before, and the scope to read it."""
    scope = Scope(rel, number=number)
    wanted = {rel.position(n.args[0].value) for n in walk(node) if n.kind == "func" and n.value == "prev"}
    if wanted:
        rel, names, first = previous_values(rel, [rel.fields[i].physical for i in sorted(wanted)])
        scope = Scope(rel, dict(zip(sorted(wanted), names, strict=True)), first, number)
    return rel, scope


def select(rel: Relation, args: dict, number: str | None) -> Relation:
    node = args["expr"]
    rel, scope = _scope(rel, node, number)
    keep = condition(scope, node)
    if args["invert"]:
        keep = ~keep
    if not (args["before"] or args["after"]):
        return rel.with_(df=rel.df.filter(keep), row_number=None)
    hit = fresh("hit")
    rel = rel.with_(df=rel.df.withColumn(hit, keep), row_number=None)
    return near_hits(rel, hit, args["before"], args["after"])


def add(rel: Relation, args: dict, number: str | None) -> Relation:
    node, name = args["expr"], args["name"]
    rel, scope = _scope(rel, node, number)
    value = evaluate(scope, node)
    rel, physical = rel.add(value)
    made = Field(name, physical, value.kind, value.static)
    if can_fail(scope, node):
        # a column that nothing reads is pruned and its errors with it; a filter that
        # always holds, but not so that the optimizer can tell, is not
        rel = rel.with_(df=rel.df.filter(F.hash(physical) >= -(1 << 31)))
    if name in rel.header:
        at = rel.header.index(name)
    elif name.isdigit() and not args["quoted"]:
        at = rel.position(name)
        made = replace(made, name=rel.fields[at].name)
    else:
        return rel.with_(fields=[*rel.fields, made])
    return rel.with_(fields=[*rel.fields[:at], made, *rel.fields[at + 1 :]])


def _range(rel: Relation, text: str) -> list[int] | None:
    """Positions of an inclusive range like 2-4, a:d or 2:name; None if it is none."""
    m = re.fullmatch(r"(\d+)-(\d+)", text) or re.fullmatch(r"([^:]+):([^:]+)", text)
    if text in rel.header or not m:
        return None
    a, b = rel.position(m[1]), rel.position(m[2])
    if a > b:
        raise ScriptError(f"the range '{text}' runs backwards")
    return list(range(a, b + 1))


def cols(rel: Relation, args: dict) -> Relation:
    chosen: list[int] = []
    for name, quoted in args["columns"]:
        span = None if quoted else _range(rel, name)
        if span is not None:
            chosen += span
        elif args["drop"] and name not in rel.header and not name.isdigit():
            continue
        else:
            chosen.append(rel.position(name))
    if args["drop"]:
        chosen = [i for i in range(len(rel.fields)) if i not in set(chosen)]
    return rel.with_(fields=[rel.fields[i] for i in chosen])


def rename(rel: Relation, args: dict) -> Relation:
    for old, new in args["pairs"]:
        at = rel.position(old)
        rel = rel.with_(fields=[replace(f, name=new) if i == at else f for i, f in enumerate(rel.fields)])
    return rel


def sort(rel: Relation, args: dict) -> Relation:
    keys: list[tuple[str, bool]] = []
    df = rel.df
    for name, mode, reverse in args["keys"]:
        f = rel.get(name)
        v = f.value()
        mode = mode or {"Num": "n", "Str": "s"}.get(f.static or "", "")
        if mode == "s":
            columns = [v.text()]
        elif mode == "n" or v.kind in ("num", "int"):
            columns = _number_keys(v, v.number())
        else:
            number = v.soft()
            columns = [number.isNull(), *_number_keys(v, number), F.when(number.isNull(), v.text())]
        for c in columns:
            k = fresh("key")
            df = df.withColumn(k, c)
            keys.append((k, not reverse))
    return rel.with_(df=df).sorted_by([*keys, *rel.order])


def _number_keys(v: Value, number: Column) -> list[Column]:
    """Order of numbers: NaN last; minus zero before zero, which integers do not have."""
    if v.kind == "int":
        return [number]
    zero = F.when(number == 0, F.when(number.cast("string") == "-0.0", 0).otherwise(1))
    return [number, zero]


def head(rel: Relation, args: dict) -> Relation:
    if "first" in args:
        df = rel.df.orderBy(*rel.order_columns()) if rel.order else rel.df
        return rel.with_(df=df.limit(args["first"]), row_number=None)
    total = fresh("total")
    rel, n = number_rows(rel, total)
    return rel.with_(df=rel.df.filter(F.col(n) <= F.col(total) - args["but_last"]), row_number=None)


def tail(rel: Relation, args: dict) -> Relation:
    if "last" in args:
        return rel.with_(df=rel.df.orderBy(*rel.order_columns(reverse=True)).limit(args["last"]), row_number=None)
    if args["from"] == 1:
        return rel
    rel, n = number_rows(rel)
    return rel.with_(df=rel.df.filter(F.col(n) >= args["from"]), row_number=None)


def _key(f: Field) -> Column:
    """What rows are the same by: the output text, which whole numbers stand for themselves."""
    v = f.value()
    return F.col(f.physical) if v.kind == "int" else v.text()


def uniq(rel: Relation, args: dict) -> Relation:
    """The first row of each key: an aggregate with partial results, not a window over all rows."""
    fields = [rel.get(c) for c in args["columns"]] or rel.fields
    keys = {fresh("key"): _key(f) for f in fields}
    rel = _rising(rel)
    if rel.ordinal:  # the least place of each key, and then the rows that stand there
        first = rel.df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(F.min(rel.ordinal).alias("_first")).select("_first")
        return rel.with_(df=rel.df.join(first, F.col(rel.ordinal) == F.col("_first"), "left_semi"), row_number=None)
    kept = list(dict.fromkeys([*(f.physical for f in rel.fields), *(c for c, _ in rel.order)]))
    place = F.struct(*(F.col(c) for c, _ in rel.order)) if rel.order else F.lit(0)
    df = rel.df.withColumns(keys).groupBy(*keys)
    df = df.agg(F.min_by(F.struct(*kept), place).alias("_row")).select("_row.*")
    return rel.with_(df=df, row_number=None)


def _rising(rel: Relation) -> Relation:
    """The relation with an order that has a least place, as one number where that costs no sort."""
    if not rel.order:
        return rel
    rel = with_ordinal(rel)
    return rel if rel.ordinal or all(up for _, up in rel.order) else settled(rel)


def _parts(v: Value) -> dict[str, Column]:
    """What the aggregates of a column are made of."""
    number, text = v.optional(), v.text()
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    filled = number.isNotNull() if v.kind in ("num", "int") else text != ""
    return {"x": F.when(finite, number), "filled": filled, "bad": filled & number.isNull(), "text": F.when(filled, text)}


def aggregate_value(fn: str, v: Value) -> tuple[Column, str, str | None]:
    """(aggregate, kind, static type); blanks are null."""
    if v.kind in ("num", "int"):
        x = _parts(v)["x"] if v.kind == "num" else v.column
        plain = {
            "count": (F.count(v.column), "int", "Num"),
            "count_distinct": (F.count_distinct(v.column), "int", "Num"),
            "sum": (F.sum(x.cast("double")), "num", "Num"),
            "mean": (F.avg(x.cast("double")), "num", "Num"),
            "stddev": (F.stddev_samp(x.cast("double")), "num", "Num"),
            "min": (F.min(x), v.kind, v.static),
            "max": (F.max(x), v.kind, v.static),
        }
        return plain[fn]
    p = _parts(v)
    numeric = F.coalesce(F.max(p["bad"].cast("int")), F.lit(0)) == 0
    if fn == "count":
        return F.count(F.when(p["filled"], 1)), "int", "Num"
    if fn == "count_distinct":
        return F.count_distinct(p["text"]), "int", "Num"
    if fn in ("min", "max"):
        pick = F.min if fn == "min" else F.max
        number = F.when(numeric, pick(p["x"]))
        text = F.when(~numeric, pick(p["text"]))
        return F.struct(number.alias("n"), text.alias("s")), "mixed", v.static
    made = {"sum": F.sum, "mean": F.avg, "stddev": F.stddev_samp}[fn]
    return F.when(numeric, made(p["x"])), "num", "Num"


def agg(rel: Relation, args: dict) -> Relation:
    keys = [rel.get(k) for k in args["keys"]]
    rel = _rising(rel) if keys else rel
    physical = [fresh("k") for _ in keys]
    made, fields = [], []
    for (name, fn, col) in args["aggregates"]:
        if not col:
            column, kind, static = F.count(F.lit(1)), "int", "Num"
        else:
            f = rel.get(col)
            column, kind, static = aggregate_value(fn, f.value())
        p = fresh("a")
        made.append(column.alias(p))
        fields.append(Field(name or (f"{rel.get(col).name}_{fn}" if col else "count"), p, kind, static))
    names = [k.name for k in keys] + [f.name for f in fields]
    if len(set(names)) < len(names):
        raise ScriptError(f"agg makes the column '{next(n for n in names if names.count(n) > 1)}' twice; name one with NAME=")
    order: list[tuple[str, bool]] = []
    if rel.order and keys:
        place = fresh("place")
        least = F.col(rel.ordinal) if rel.ordinal else F.struct(*(c for c, _ in rel.order))
        made.append(F.min(least).alias(place))
        order = [(place, True)]
    if keys:
        df = rel.df.groupBy(*(_key(k).alias(p) for k, p in zip(keys, physical, strict=True))).agg(*made)
    else:
        total = fresh("n")
        df = rel.df.agg(*made, F.count(F.lit(1)).alias(total)).filter(F.col(total) > 0)
    kept = []
    for k, p in zip(keys, physical, strict=True):
        if k.kind == "num":
            df = df.withColumn(p, F.when(F.col(p) != "", F.col(p).cast("double")))
        kept.append(Field(k.name, p, k.kind if k.kind in ("num", "int") else "text", k.static))
    known = {"ordinal": order[0][0], "buckets": chunked(order[0][0])} if order and rel.ordinal else {}
    return Relation(df, [*kept, *fields], order, **known)


_STATS = (("count", "int"), ("empty", "int"), ("min", "text"), ("max", "text"), ("sum", "num"), ("mean", "num"), ("stddev", "num"))


def stats(rel: Relation, args: dict) -> Relation:
    """One row for each column, from one aggregation over all rows."""
    fields = [rel.get(c) for c in args["columns"]] or rel.fields
    rows = []
    for i, f in enumerate(fields):
        v = f.value()
        found = {fn: aggregate_value(fn, v) for fn in ("count", "min", "max", "sum", "mean", "stddev")}
        cells = [F.lit(i).alias("i"), F.lit(f.name).alias("field"), found["count"][0].alias("count")]
        cells.append((F.count(F.lit(1)) - found["count"][0]).alias("empty"))
        for fn in ("min", "max"):
            column, kind, _ = found[fn]
            cells.append((column if kind == "mixed" else F.struct(column.cast("double").alias("n"), F.lit(None).cast("string").alias("s"))).alias(fn))
        cells += [found[fn][0].alias(fn) for fn in ("sum", "mean", "stddev")]
        rows.append(F.struct(*cells))
    names = ["i", "field", *(n for n, _ in _STATS)]
    physical = {n: fresh(n) for n in names}
    df = rel.df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows")).toDF(*(physical[n] for n in names))
    for n in ("min", "max"):
        c = F.col(physical[n])
        df = df.withColumn(physical[n], F.coalesce(formatted(c["n"]), c["s"]))
    out = [Field("field", physical["field"], "text", "Str")]
    out += [Field(n, physical[n], kind, None if n in ("min", "max") else "Num") for n, kind in _STATS]
    return Relation(df, out, [(physical["i"], True)])


def needs_number(stages: list[Stage]) -> bool:
    return any(uses(s.args["expr"], "rownum") for s in stages if s.verb in ("select", "add"))
