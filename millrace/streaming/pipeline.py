"""Scripts over unbounded inputs with Structured Streaming.

Verbs that look at one row at a time run as a stateless append query; an inner or left
join meets a static right side; ``uniq`` keeps its keys as state; ``agg`` runs in
complete mode; ``head N`` takes the first rows to arrive.  Verbs that need the order or the
end of the input (sort, tail, stats, prev, rownum, context, graph, right and full joins)
have no streaming form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..engine import Engine, Output
from ..operators.stages import _key
from ..plans.errors import ScriptError
from ..plans.relation import fresh
from ..plans.script import Stage, parse, uses
from ..sources.files import from_frame

_ROWWISE = {"select", "add", "cols", "rename"}


def _check(stages: list[Stage]) -> str:
    """The output mode of a script, or an error naming the stage that cannot stream."""
    mode = "append"
    for s in stages:
        if s.verb in ("select", "add") and uses(s.args["expr"], "prev", "rownum"):
            raise ScriptError(f"'{s.text}' needs the order of rows, which a stream has not")
        if s.verb == "select" and (s.args["before"] or s.args["after"]):
            raise ScriptError(f"'{s.text}' needs rows around a match, which a stream has not")
        if s.verb == "join" and s.args["how"] in ("right", "full"):
            raise ScriptError(f"'{s.text}' needs the end of the input")
        if s.verb == "agg":
            if mode == "complete":
                raise ScriptError("a stream is aggregated once")
            mode = "complete"
        elif s.verb not in _ROWWISE | {"join", "uniq", "fmt", "color"} and not (s.verb == "head" and "first" in s.args):
            raise ScriptError(f"'{s.verb}' has no streaming form")
    return mode


def stream(spark: SparkSession, script: str, source: DataFrame, folder: str = ".") -> tuple[DataFrame, str]:
    """The streaming result of a script over a streaming DataFrame, and its output mode."""
    stages = parse(script)
    mode = _check(stages)
    engine = Engine(spark, folder)
    out = Output(from_frame(source))
    for s in stages:
        if s.verb != "uniq":
            out = engine._compile(out.relation, [s])
            continue
        rel = out.relation
        keys = {fresh("key"): _key(rel.get(c)) for c in s.args["columns"] or rel.header}
        out = Output(rel.with_(df=rel.df.withColumns(keys).dropDuplicates(list(keys))))
    return out.frame(), mode


def text_stream(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """A stream of headerless CSV lines from the files that appear in a folder."""
    schema = ", ".join(f"`{n}` string" for n in names)
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    cells = F.from_csv(F.regexp_replace("value", "\r$", ""), schema, {"quote": '"', "escape": '"', "emptyValue": ""})
    return lines.select(cells.alias("r")).select(*(F.coalesce(F.col(f"r.`{n}`"), F.lit("")).alias(n) for n in names))


def writer(spark: SparkSession, script: str, source: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer with the output mode that the script needs; the caller names the sink."""
    frame, mode = stream(spark, script, source)
    return frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
