"""Joins on output text, with the left order kept and the right order inside it.

Which side is built or broadcast is left to adaptive execution, which knows their
sizes.  Keys of one numeric type on both sides are compared as numbers; otherwise as
the texts that would be written.  Blank keys match blank keys.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import Value
from ..plans.errors import ScriptError
from ..plans.relation import Field, Relation, fresh


def _same(left: Field, right: Field) -> tuple[Column, Column]:
    a, b = left.value(), right.value()
    if a.kind == b.kind == "int":
        blank = F.lit(None).cast("long")
        return F.coalesce(a.column.cast("long"), blank), F.coalesce(b.column.cast("long"), blank)
    return a.text(), b.text()


def _free(name: str, taken: list[str], suffix: str) -> str:
    """*name* with the suffix if it is taken, and more of it until it is free."""
    if name not in taken:
        return name
    base = made = name + suffix
    n = 1
    while made in taken:
        n += 1
        made = f"{base}_r" if n == 2 and suffix != "_r" else f"{name}_r{n}"
    return made


def headers(left: list[str], right: list[str], keys: list[str], left_suffix: str, right_suffix: str) -> tuple[list[str], list[str]]:
    """Both sides' names after clashes are settled; left keys keep their names."""
    clash = {n for n in left if n in right and n not in keys}
    new_left = [n + left_suffix if n in clash and left_suffix else n for n in left]
    new_right: list[str] = []
    for n in right:
        if n in clash or n in new_left:
            n = _free(n, [*new_left, *new_right], right_suffix) if not (n in clash and right_suffix != "_r") else _free(n + right_suffix, [*new_left, *new_right], "_r")
        new_right.append(_free(n, [*new_left, *new_right], "_r"))
    return new_left, new_right


def join(left: Relation, right: Relation, on: list[str], how: str, left_suffix: str = "", right_suffix: str = "_r") -> Relation:
    pairs = [k.split("=", 1) if "=" in k else (k, k) for k in on]
    lk, rk = [left.get(a) for a, _ in pairs], [right.get(b) for _, b in pairs]
    if not pairs:
        raise ScriptError("join needs keys")
    names = [fresh("k") for _ in pairs]
    ldf, rdf = left.df, right.df
    conditions = []
    for n, a, b in zip(names, lk, rk, strict=True):
        x, y = _same(a, b)
        ldf, rdf = ldf.withColumn(f"{n}l", x), rdf.withColumn(f"{n}r", y)
        same = F.col(f"{n}l").eqNullSafe(F.col(f"{n}r")) if a.kind == b.kind == "int" else F.col(f"{n}l") == F.col(f"{n}r")
        conditions.append(same)
    met = fresh("met")
    ldf = ldf.withColumn(met, F.lit(True))
    test = conditions[0]
    for c in conditions[1:]:
        test = test & c
    df = ldf.join(rdf, test, {"inner": "inner", "left": "left", "right": "right", "full": "full_outer"}[how])
    fields = list(left.fields)
    if how in ("right", "full"):
        for a, b in zip(lk, rk, strict=True):
            p = fresh("key")
            alike = a.kind == b.kind
            own, other = (F.col(a.physical), F.col(b.physical)) if alike else (a.value().text(), b.value().text())
            df = df.withColumn(p, F.when(F.col(met), own).otherwise(other))
            fields = [replace(f, physical=p, kind=f.kind if alike else "text") if f.physical == a.physical else f for f in fields]
    rest = [f for f in right.fields if f.physical not in {k.physical for k in rk}]
    keys = [f.name for f in lk]
    new_left, new_right = headers([f.name for f in fields], [f.name for f in rest], keys, left_suffix, right_suffix)
    fields = [replace(f, name=n) for f, n in zip(fields, new_left, strict=True)]
    fields += [replace(f, name=n, static=None) for f, n in zip(rest, new_right, strict=True)]
    order = [*left.order, *right.order]
    if how in ("right", "full"):  # right rows without a partner come last
        order = [(met, False), *order]
        df = df.withColumn(met, F.coalesce(F.col(met), F.lit(False)))
        return Relation(df, fields, order)
    return Relation(df, fields, order, buckets=left.buckets)


def as_text(rel: Relation) -> Relation:
    """Numbers computed on the right side become the text a CSV file would hold."""
    df, fields = rel.df, []
    for f in rel.fields:
        if f.kind in ("mixed", "bool"):
            p = fresh("t")
            df = df.withColumn(p, Value(f.kind, F.col(f.physical)).text())
            f = Field(f.name, p, "text")
        fields.append(replace(f, static=None))
    return rel.with_(df=df, fields=fields)


def with_suffix(rel: Relation, suffix: str, keys: list[str]) -> Relation:
    if not suffix:
        return rel
    return rel.with_(fields=[f if f.name in keys else replace(f, name=f"{f.name}_{suffix}") for f in rel.fields])
