"""The engine: a script over an input, compiled to one DataFrame."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.evaluate import Scope, condition
from .functions.values import parsed, trimmed
from .operators import charts, joins, stages
from .operators.numbering import number_rows
from .plans import describe
from .plans.errors import ScriptError
from .plans.relation import Relation
from .plans.script import Stage, parse
from .sources import files

_TRANSFORMS = {"cols", "rename", "select", "add"}


@dataclass
class Output:
    """A compiled script: typed columns, the order, and how it is to be shown."""

    relation: Relation
    table: dict[str, Any] | None = None
    chart: dict[str, Any] | None = None
    colors: list[dict[str, Any]] = field(default_factory=list)
    plan: list[str] = field(default_factory=list)
    notes: Callable[[], list[str]] = list  # what a chart leaves out

    @property
    def header(self) -> list[str]:
        return self.relation.header

    def _columns(self, as_text: bool) -> list[Column]:
        out = []
        for i, f in enumerate(self.relation.fields):
            v = f.value()
            plain = v.column if v.kind in ("text", "num", "int", "time") else v.text()
            out.append((v.text() if as_text else plain).alias(f"_{i}"))
        return out

    def frame(self, ordered: bool = False, as_text: bool = False) -> DataFrame:
        """The result as a DataFrame; typed, or as the texts a CSV file would hold."""
        df = self.relation.df
        if ordered and self.relation.order:
            df = df.orderBy(*self.relation.order_columns())
        return df.select(*self._columns(as_text)).toDF(*self.header)

    def typed(self, ordered: bool = True) -> DataFrame:
        """The result with the types that its cells tell: a column of numbers is double, all else text.

        Blank cells of a number column are NaN; a column without any rows is text, one of
        blanks alone is double.  Numbers that are written like codes (a leading zero or
        plus) make a text column.
        """
        frame = self.frame(ordered, as_text=True).toDF(*(f"_{i}" for i in range(len(self.header))))
        checks = []
        for c in frame.columns:
            cell = F.col(c)
            code = cell.rlike(r"^\s*([+]|-?0[0-9])")
            text = (trimmed(cell) != "") & (parsed(cell).isNull() | code)
            checks.append((F.count_if(text) == 0).alias(c))
        numeric = frame.agg(F.count(F.lit(1)).alias("rows"), *checks).first()
        plain = [
            F.coalesce(parsed(F.col(c)), F.lit(float("nan"))).alias(c) if numeric["rows"] and numeric[c] else F.col(c) for c in frame.columns
        ]
        return frame.select(*plain).toDF(*self.header)

    def columns(self) -> dict[str, list]:
        """The typed result as lists, for callers that hold it in memory."""
        rows = self.typed().collect()
        return {name: [r[i] for r in rows] for i, name in enumerate(self.header)}

    def rows(self) -> Iterator[list[str]]:
        """The output rows as texts, in order, one partition at a time."""
        for row in self.frame(ordered=True, as_text=True).toLocalIterator(prefetchPartitions=True):
            yield list(row)


class Engine:
    """Runs pipe scripts: ``Engine(spark).run("select a > 1 | head 5", "in.csv")``."""

    def __init__(self, spark: SparkSession, folder: str = ".") -> None:
        self.spark, self.folder = spark, folder

    def run(self, script: str, source: str | DataFrame | None = None, header: str | None = None, format: str | None = None) -> Output:
        todo = parse(script)
        first = bool(todo) and todo[0].verb == "from"
        if any(s.verb == "from" for s in todo[1:]):
            raise ScriptError("from must be the first stage")
        if first and source is not None:
            raise ScriptError("the script names its input with from; give no other")
        if first:
            rel = self._from(todo[0], header)
            todo = todo[1:]
        elif source is None:
            raise ScriptError("no input: give a file or start with from")
        else:
            rel = self._open(source, header, format)
        return self._compile(rel, todo)

    def explain(self, script: str, source: str | DataFrame | None = None, **options: Any) -> str:
        """The resolved stages with columns and comparison modes, then Spark's plan."""
        out = self.run(script, source, **options)
        plan = out.frame()._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n".join([*out.plan, f"output: {', '.join(out.header)}", "", plan])

    def _path(self, name: str) -> str:
        return name if "://" in name or os.path.isabs(name) else os.path.join(self.folder, name)

    def _open(self, source: str | DataFrame, header: str | None = None, format: str | None = None) -> Relation:
        if isinstance(source, DataFrame):
            return files.from_frame(source)
        return files.scan(self.spark, self._path(source), header, format)

    def _item(self, item: dict[str, Any], path: str, header: str | None = None) -> Relation:
        rel = self._open(path, header)
        if item["sub"] is not None:
            rel = joins.as_text(self._compile(rel, item["sub"]).relation)
        return rel

    def _expanded(self, item: dict[str, Any]) -> list[tuple[str, str]]:
        if item["literal"] or not files.is_pattern(self.spark, self._path(item["file"])):
            return [(item["file"], "")]
        return files.expand(self.spark, item["file"], self.folder)

    def _from(self, stage: Stage, header: str | None) -> Relation:
        rel = None
        for item in stage.args["files"]:
            keys = item["on"] or []
            found = self._expanded(item)
            if len(found) > 1 and not keys:
                raise ScriptError("from with several files needs 'on KEYS'")
            for path, part in found:
                one = joins.with_suffix(self._item(item, path, header), part, [k.split("=")[-1] for k in keys])
                rel = one if rel is None else joins.join(rel, one, keys, "inner", item.get("left_suffix", ""), item.get("right_suffix", "_r"))
        return rel

    def _join(self, rel: Relation, args: dict[str, Any]) -> Relation:
        for item in args["files"]:
            for path, part in self._expanded(item):
                right = joins.with_suffix(self._item(item, path), part, [k.split("=")[-1] for k in item["on"]])
                rel = joins.join(rel, right, item["on"], args["how"], item.get("left_suffix", ""), item.get("right_suffix", "_r"))
        return rel

    def _compile(self, rel: Relation, todo: list[Stage]) -> Output:
        out = Output(rel)
        number: str | None = None
        in_run = False
        for i, stage in enumerate(todo):
            verb, args = stage.verb, stage.args
            if verb not in ("fmt", "color"):
                out.plan.append(f"{len(out.plan) + 1}  {describe.stage(rel, stage)}")
            if verb in _TRANSFORMS:
                if not in_run:  # rownum() counts the rows that enter a run of these
                    run = []
                    for s in todo[i:]:
                        if s.verb not in _TRANSFORMS:
                            break
                        run.append(s)
                    number = None
                    if stages.needs_number(run):
                        rel, number = number_rows(rel)
                in_run = True
                rel = getattr(stages, verb)(rel, args, number) if verb in ("select", "add") else getattr(stages, verb)(rel, args)
                continue
            if verb in ("fmt", "color"):
                if verb == "fmt":
                    out.table = args
                else:
                    out.colors.append(args)
                continue
            in_run = False
            if verb == "join":
                rel = self._join(rel, args)
            elif verb == "agg":
                rel = stages.agg(rel, args)
            elif verb == "uniq":
                rel = stages.uniq(rel, args)
            elif verb == "graph":
                if i + 1 < len(todo) and any(s.verb not in ("color", "fmt") for s in todo[i + 1 :]):
                    raise ScriptError("graph must be the last stage")
                out.chart, out.notes = args, partial(charts.notes, rel, args)
                rel = charts.CHARTS[args["kind"]](rel, args)
            else:
                rel = getattr(stages, verb)(rel, args)
        out.relation = rel
        return out


def painted(out: Output) -> list[tuple[dict[str, Any], Column]]:
    """The colour rules whose columns are in the output, as conditions over its rows."""
    found = []
    for rule in out.colors:
        if "expr" not in rule:
            continue
        try:
            found.append((rule, condition(Scope(out.relation), rule["expr"])))
        except ScriptError:
            continue
    return found
