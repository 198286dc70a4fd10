"""Command line: ``python -m millrace [options] SCRIPT [INPUT]``."""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
from collections.abc import Iterator
from typing import BinaryIO, TextIO

from pyspark.sql import SparkSession

from .engine import Engine, Output
from .plans.errors import ScriptError, suggestion
from .plans.script import VERBS, parse, uses
from .sources import draw, writers

HELP = {
    "cols": "cols a,b | cols -v a | cols 1,3 2-4 a:d — keep or drop columns",
    "select": "select [-v] [-B N] [-A M] EXPR — keep rows where EXPR is true",
    "sort": "sort col[=nsr]… — stable sort: n numeric, s text, r reverse",
    "head": "head [N] | head -n -N — the first rows, or all but the last N",
    "tail": "tail [N] | tail +N — the last rows, or from row N",
    "stats": "stats [cols] — one row of figures for each column",
    "uniq": "uniq [cols] — the first row of each kind",
    "color": "color [-c COL] SPEC EXPR | color -g COLS [a:b] — colours",
    "rename": "rename old=new… — new column names",
    "fmt": "fmt [-s] [-f | -p N] [-h] — an aligned table",
    "from": "from [(SUB)] FILE[, …] [on KEYS] — the input",
    "join": "join [-l|-r|-F] [(SUB)] FILE on KEYS — merge rows of a file",
    "add": "add NAME = EXPR — a computed column",
    "agg": "agg [NAME=]FN(col)… [by cols] — figures for each group",
    "graph": "graph [hist|bar|spark|line|scatter|heatmap] COLS [-D | -S] — a chart",
}


TOPICS = {
    "expressions": "?:  ||  &&  !  == != < > <= >= =~ !~ ^= *= $=  ++  + -  * / %  and functions; columns with odd names in backticks",
    "functions": "round floor ceil int abs sqrt pow exp log log10 log2 sign min max len upper lower trim num str coalesce prev rownum",
    "columns": "by name, by position from 1, and in cols by ranges: 2-4, a:d",
    "modes": "a comparison is numeric if a side is a number, text if a side is text or for == and !=, else auto: numbers where both read as such",
    "fragments": "fn name(a, b) { stages } before the first stage; name(x, y) stands for the stages",
    "patterns": "from and join take * ? {a,b} {1..9} in file names; the columns of each file get what the pattern stood for",
}

#: Bytes of standard input that are taken at a time where rows go through one by one.
PIECE_BYTES = 32 << 20
_ROWWISE = {"select", "add", "cols", "rename", "color"}


def _rowwise(script: str) -> bool:
    """Whether a script's rows go through one by one, so that input can be taken piece by piece."""
    return all(
        s.verb in _ROWWISE and not (s.args.get("before") or s.args.get("after")) and not ("expr" in s.args and uses(s.args["expr"], "prev", "rownum"))
        for s in parse(script)
    )


def _pieces(source: BinaryIO, headed: bool) -> Iterator[str]:
    """Files of whole lines of the input, each with its header line, each removed after use."""
    head, rest, first = source.readline() if headed else b"", b"", True
    while True:
        piece = source.read1(PIECE_BYTES)
        lines, gap, last = (rest + piece).rpartition(b"\n") if piece else (rest, b"", b"")
        rest = last
        if lines or (first and not piece):
            with tempfile.NamedTemporaryFile("wb", suffix=".csv") as f:
                f.write(head + lines + gap)
                f.flush()
                yield f.name
            first = False
        if not piece:
            return


def _lines(out: Output, to: TextIO, color: str) -> Iterator[str]:
    depth = draw.color_depth(color, to.isatty(), os.environ)
    if out.chart is not None and not out.chart.get("data"):
        yield from draw.svg(out).splitlines() if out.chart.get("svg") else draw.terminal(out, depth)
    elif out.table is not None:
        yield from writers.table_text(out, stripes=depth > 0)
    elif out.colors and depth:
        yield writers.csv_line(out.header)
        yield from (writers.csv_line(r) for r in draw.colored(out, depth))
    else:
        yield from writers.csv_text(out)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("millrace")
    p.add_argument("script", nargs="?")
    p.add_argument("input", nargs="?")
    p.add_argument("-f", "--file", help="read the script from a file")
    p.add_argument("-o", "--output", default="-", help="a file, or a folder (ending in /) of parts that all tasks write")
    p.add_argument("--header", help="the input has no header: a,b,c or - for c1,c2,…")
    p.add_argument("--format", choices=["csv", "parquet"])
    p.add_argument("--color", choices=["auto", "always", "never"], default="auto")
    p.add_argument("--explain", action="store_true")
    a = p.parse_args(argv)
    if a.script == "help":
        known = HELP | TOPICS
        if a.input and a.input not in known:
            print(f"millrace: no help on '{a.input}'{suggestion(a.input, list(known))}", file=sys.stderr)
            return 1
        print(known[a.input] if a.input else "\n".join([*(HELP[v] for v in VERBS), "", *(f"{k}: {v}" for k, v in TOPICS.items())]))
        return 0
    if a.file:
        a.script, a.input = open(a.file, encoding="utf-8").read(), a.script
    if a.script is None:
        p.error("a script is needed")
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine, options = Engine(spark), {"header": a.header, "format": a.format}
    try:
        named = a.input if a.input not in (None, "-") else None
        if named is None and not parse(a.script)[:1] or named is None and parse(a.script)[0].verb != "from":
            if a.format == "parquet":
                raise ScriptError("Parquet is read from a file, not from standard input")
            sources = _pieces(sys.stdin.buffer, a.header is None) if _rowwise(a.script) and not a.explain else _whole(sys.stdin.buffer)
        else:
            sources = iter([named])
        to = sys.stdout if a.output == "-" or a.output.endswith("/") else open(a.output, "w", encoding="utf-8", newline="")
        for number, source in enumerate(sources):
            if a.explain:
                print(engine.explain(a.script, source, **options))
                return 0
            out = engine.run(a.script, source, **options)
            plain = out.chart is None or out.chart.get("data")
            if a.output.endswith("/"):
                writers.write_csv(out, a.output.rstrip("/") + (f"/piece-{number}" if number else ""))
            elif a.output != "-" and plain and out.table is None and named is not None:
                writers.write_file(out, a.output)
            else:
                lines = _lines(out, to, a.color)
                if number:
                    next(lines)  # the header came with the first piece
                for line in lines:
                    to.write(f"{line}\n")
                to.flush()
    except ScriptError as e:
        print(f"millrace: {e}", file=sys.stderr)
        return 1
    return 0


def _whole(source: BinaryIO) -> Iterator[str]:
    """A file of all input, removed after use."""
    with tempfile.NamedTemporaryFile("wb", suffix=".csv") as f:
        while piece := source.read(1 << 20):
            f.write(piece)
        f.flush()
        yield f.name


if __name__ == "__main__":
    sys.exit(main())
