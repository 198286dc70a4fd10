"""Charts as reductions: Spark makes the few rows that a drawing needs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import Value
from ..plans.errors import ScriptError
from ..plans.relation import Field, Relation, fresh
from .numbering import number_rows

MOST_BINS, MOST_BARS, WIDTH, GRID = 50, 50, 80, 64
# Timestamps that chart axes read.
_STAMP = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2})(:\d{2})?(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"


def _finite(v: Value) -> Column:
    x = v.optional()
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _clip(x: Column, bounds: tuple[float, float] | None) -> Column:
    return x if bounds is None else F.when((x >= bounds[0]) & (x <= bounds[1]), x)


def edge(lo: float, hi: float, i: int, n: int) -> float:
    """The i-th of n+1 edges, exact at both ends."""
    return lo if i == 0 else hi if i == n else lo * (1 - i / n) + hi * (i / n)


def _cell(x: Column, lo: float, hi: float, n: int) -> Column:
    span = hi / 2 - lo / 2
    if span == 0:
        return F.lit(0)
    part = (x / 2 - lo / 2) / span
    return F.least(F.floor(part * n), F.lit(n - 1)).cast("int")


def hist(rel: Relation, args: dict) -> Relation:
    f = rel.get(args["columns"][0])
    x = _clip(_finite(f.value()), args.get("xrange"))
    df = rel.df.select(x.alias("x")).filter("x IS NOT NULL")
    n, lo, hi = df.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        raise ScriptError(f"'{f.name}' has no numbers to draw")
    if args.get("xrange"):
        lo, hi = args["xrange"]
    bins = args.get("bins") or min(MOST_BINS, max(1, math.ceil(math.log2(n)) + 1))
    counts = df.groupBy(_cell(F.col("x"), lo, hi, bins).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    spark = rel.df.sparkSession
    edges = spark.createDataFrame([(i, edge(lo, hi, i, bins), edge(lo, hi, i + 1, bins)) for i in range(bins)], "i int, bin_lo double, bin_hi double")
    made = edges.join(counts, "i", "left").select("i", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("count"))
    names = {"i": fresh("i"), "bin_lo": fresh("lo"), "bin_hi": fresh("hi"), "count": fresh("n")}
    fields = [Field("bin_lo", names["bin_lo"], "num", "Num"), Field("bin_hi", names["bin_hi"], "num", "Num"), Field("count", names["count"], "int", "Num")]
    return Relation(made.toDF(*names.values()), fields, [(names["i"], True)])


def bar(rel: Relation, args: dict) -> Relation:
    label, *series = (rel.get(c) for c in args["columns"])
    values = [_finite(s.value()) for s in series]
    some = values[0].isNotNull()
    for v in values[1:]:
        some = some | v.isNotNull()
    df, fields = rel.df.filter(some), [label]
    for s, v in zip(series, values, strict=True):
        p = fresh("v")
        df = df.withColumn(p, v)
        fields.append(Field(s.name, p, "num", "Num"))
    return rel.with_(df=df, fields=fields, row_number=None)


def spark_line(rel: Relation, args: dict) -> Relation:
    """Bucket means: bucket i of w has the rows from i*n/w up to (i+1)*n/w."""
    f = rel.get(args["columns"][0])
    x = _clip(_finite(f.value()), args.get("yrange"))
    if args.get("log"):
        x = F.when(x > 0, x)
    p = fresh("x")
    rel = rel.with_(df=rel.df.withColumn(p, x).filter(F.col(p).isNotNull()), row_number=None)
    n = rel.df.count()
    width = min(n, args.get("width") or WIDTH)
    rel, number = number_rows(rel)
    i = F.floor(((F.col(number) - 1) * width + width - 1) / n) if n else F.lit(0)
    # the bucket of row r (from 0): the largest i with floor(i*n/w) <= r
    i = F.floor((F.col(number) * width - 1) / F.lit(float(n or 1)))
    b, v = fresh("b"), fresh("v")
    df = rel.df.groupBy((i + 1).cast("long").alias(b)).agg(F.avg(p).alias(v))
    return Relation(df, [Field("bucket", b, "int", "Num"), Field(f.name, v, "num", "Num")], [(b, True)])


def seconds(v: Value) -> Column:
    """Seconds since 1970 UTC of a timestamp text, else null."""
    if v.kind == "time":
        return F.unix_micros(v.column.cast("timestamp")) / 1e6
    text = v.text()
    zone = F.regexp_extract(text, _STAMP, 5)
    plain = F.concat(F.regexp_extract(text, _STAMP, 1), F.lit(" "), F.regexp_extract(text, _STAMP, 2))
    plain = F.concat(plain, F.coalesce(F.nullif(F.regexp_extract(text, _STAMP, 3), F.lit("")), F.lit(":00")), F.regexp_extract(text, _STAMP, 4))
    shown = F.concat(plain, F.when(zone == "", "Z").otherwise(zone))
    return F.when(text.rlike(_STAMP), F.unix_micros(shown.try_cast("timestamp")) / 1e6)


def axis(rel: Relation, f: Field) -> tuple[Relation, Column]:
    """The x values: numbers if there are any, else timestamps if all are, else row numbers."""
    v = f.value()
    number, stamp = _finite(v), seconds(v)
    if v.kind in ("num", "int"):
        return rel, number
    some, rows, stamps = rel.df.agg(F.count(number), F.count(F.lit(1)), F.count(stamp)).first()
    if some:
        return rel, number
    if rows and stamps == rows:
        return rel, stamp
    rel, n = number_rows(rel)
    return rel, (F.col(n) - 1).cast("double")


def xy(rel: Relation, args: dict) -> Relation:
    xf, *ys = (rel.get(c) for c in args["columns"])
    rel, x = axis(rel, xf)
    x = _clip(x, args.get("xrange"))
    place, tint = fresh("x"), fresh("tint")
    color = _finite(rel.get(args["color_by"]).value()) if args.get("color_by") else F.lit(None).cast("double")
    df, fields, some = rel.df.withColumn(place, x).withColumn(tint, color).filter(F.col(place).isNotNull()), [xf], F.lit(False)
    args["place"], args["tint"] = place, tint
    for y in ys:
        v = _clip(_finite(y.value()), args.get("yrange"))
        v = F.when(v > 0, v) if args.get("log") else v
        p = fresh("y")
        df = df.withColumn(p, v)
        some = some | F.col(p).isNotNull()
        fields.append(Field(y.name, p, "num", "Num"))
    return rel.with_(df=df.filter(some), fields=fields, row_number=None)


def heatmap(rel: Relation, args: dict) -> Relation:
    xf, yf = (rel.get(c) for c in args["columns"])
    rel, x = axis(rel, xf)
    x, y = _clip(x, args.get("xrange")), _clip(_finite(yf.value()), args.get("yrange"))
    df = rel.df.select(x.alias("x"), y.alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    n, x0, x1, y0, y1 = df.agg(F.count(F.lit(1)), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        raise ScriptError("there are no points to draw")
    (x0, x1), (y0, y1) = args.get("xrange") or (x0, x1), args.get("yrange") or (y0, y1)
    w = h = args.get("bins") or GRID
    cx, cy = _cell(F.col("x"), x0, x1, w), _cell(F.col("y"), y0, y1, h)
    made = df.groupBy(cy.alias("j"), cx.alias("i")).agg(F.count(F.lit(1)).alias("n"))

    def low(lo: float, hi: float, i: Column, n: int) -> Column:
        return F.when(i == 0, F.lit(lo)).otherwise(F.lit(lo) * (1 - i / n) + F.lit(hi) * (i / n))

    names = [fresh(c) for c in ("j", "i", "x", "y", "n")]
    made = made.select("j", "i", low(x0, x1, F.col("i"), w), low(y0, y1, F.col("j"), h), "n").toDF(*names)
    fields = [Field(xf.name, names[2], "num", "Num"), Field(yf.name, names[3], "num", "Num"), Field("count", names[4], "int", "Num")]
    return Relation(made, fields, [(names[0], True), (names[1], True)])


def notes(rel: Relation, args: dict) -> list[str]:
    """What a chart of these rows leaves out, counted in one aggregate over its input."""
    kind, names = args["kind"], args["columns"]
    measured = names if kind in ("hist", "spark") else names[1:]
    log, none = args.get("log") and kind != "hist", F.lit(0)
    skipped = clipped = dropped = none

    def count(test: Column) -> Column:
        return F.coalesce(F.sum(F.coalesce(test, F.lit(False)).cast("long")), F.lit(0))

    bounds = args.get("xrange") if kind == "hist" else args.get("yrange")
    for name in measured:
        x = _finite(rel.get(name).value())
        inside = x if bounds is None else F.when((x >= bounds[0]) & (x <= bounds[1]), x)
        skipped = skipped + count(x.isNull())
        clipped = clipped + count(x.isNotNull() & inside.isNull())
        dropped = dropped + (count(inside <= 0) if log else none)
    if kind in ("scatter", "line", "heatmap") and args.get("xrange"):
        rel, x = axis(rel, rel.get(names[0]))
        lo, hi = args["xrange"]
        clipped = clipped + count((x < lo) | (x > hi))
    color = count(_finite(rel.get(args["color_by"]).value()).isNull()) if args.get("color_by") else none
    found = rel.df.agg(F.count(F.lit(1)).alias("rows"), skipped.alias("skipped"), clipped.alias("clipped"), dropped.alias("dropped"), color.alias("color")).first()
    more = found["rows"] - MOST_BARS if kind == "bar" else 0
    told = [
        (more, "more bars are not drawn"),
        (found["skipped"], "cells hold no number"),
        (found["clipped"], "values lie outside the range"),
        (found["dropped"], "values are not above zero"),
        (found["color"], "points have no number to colour by"),
    ]
    return [f"{n} {what}" for n, what in told if n > 0]


CHARTS = {"hist": hist, "bar": bar, "spark": spark_line, "scatter": xy, "line": xy, "heatmap": heatmap}
