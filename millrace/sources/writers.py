"""Sinks: CSV files and text, and the aligned table."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import functions as F

from .shared import remove, shared_path, store_of

if TYPE_CHECKING:
    from ..engine import Output


def csv_line(cells: list[str]) -> str:
    """One CSV line without its end; a cell is quoted only if it must be."""
    return ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c for c in cells)


def write_csv(out: Output, path: str, header: bool = True) -> None:
    """Write a folder of CSV part files, in order, the header in the first line of each or nowhere."""
    head = [csv_line(out.header)] if header else []
    frame = out.frame(ordered=True, as_text=True)
    frame = frame.toDF(*(f"c{i}" for i in range(len(out.header))))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            made = [csv_line(list(row)) for row in batch.itertuples(index=False)]
            yield pd.DataFrame({"value": [*head, *made] if first else made})
            first = False

    frame.select(*(F.coalesce(c, F.lit("")).alias(c) for c in frame.columns)).mapInPandas(lines, "value string").write.text(path)


def csv_text(out: Output) -> Iterator[str]:
    """The result as CSV lines, header first."""
    yield csv_line(out.header)
    for row in out.rows():
        yield csv_line(row)


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _number(text: str) -> Decimal | None:
    try:
        value = Decimal(text.strip())
    except (ArithmeticError, ValueError):
        return None
    return value


def shown(text: str, options: dict[str, Any]) -> str:
    """A number as a table shows it: at most six (or -p N) decimals, or -h with a suffix."""
    value = _number(text)
    if value is None or not value.is_finite():
        return text
    if options.get("human") and abs(value) >= Decimal("999.5"):
        size, n = abs(value), -1
        suffixes = "kMGTPE"
        while size >= Decimal("999.5") and n < len(suffixes) - 1:
            size, n = size / 1000, n + 1
        if size < Decimal("999.5"):
            digits = 2 if size < Decimal("9.995") else 1 if size < Decimal("99.95") else 0
            return f"{'-' if value < 0 else ''}{size:.{digits}f}{suffixes[n]}"
        return f"{value:.2e}".replace("e+", "e")
    if options.get("full"):
        return text
    places = options.get("precision", 6)
    if -value.as_tuple().exponent <= places and "e" not in text.lower():
        return text
    rounded = value.quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)
    if "e" in text.lower() and rounded == value:
        return text
    made = f"{rounded:f}"
    return made.rstrip("0").rstrip(".") if "." in made else made


def _measured(options: dict[str, Any]):
    """For each partition and column: whether cells are numbers, and the widest cell as text and as a number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, name in enumerate(batch.columns):
                cells = batch[name].tolist()
                filled = [c for c in cells if c.strip()]
                numbers = all(_number(c) is not None for c in filled)
                narrow = max(map(_width, cells), default=0)
                shorter = max((_width(shown(c, options)) for c in cells), default=0) if numbers else 0
                yield pd.DataFrame({"i": [i], "filled": [len(filled)], "numbers": [numbers], "plain": [narrow], "shown": [shorter]})

    return run


def table_text(out: Output, stripes: bool = True) -> Iterator[str]:
    """The aligned table of ``fmt``: numbers right-justified, two blanks between columns.

    Spark finds kinds and widths of the columns; rows then pass one partition at a time.
    With ``-s`` every second row is shaded where *stripes* are wanted.
    """
    options = out.table or {}
    frame = out.frame(ordered=False, as_text=True).toDF(*(f"c{i}" for i in range(len(out.header))))
    frame = frame.select(*(F.coalesce(c, F.lit("")).alias(c) for c in frame.columns))
    sizes = frame.mapInPandas(_measured(options), "i int, filled long, numbers boolean, plain int, shown int")
    sizes = sizes.groupBy("i").agg(F.sum("filled").alias("filled"), F.every("numbers").alias("numbers"), F.max("plain").alias("plain"), F.max("shown").alias("shown"))
    found = {r.i: r for r in sizes.collect()}  # a row a column
    numeric = [i in found and found[i].numbers and found[i].filled > 0 for i in range(len(out.header))]
    widths = [max(_width(h), (found[i].shown if n else found[i].plain) if i in found else 0) for i, (h, n) in enumerate(zip(out.header, numeric, strict=True))]

    def line(cells: list[str]) -> str:
        padded = []
        for c, n, w in zip(cells, numeric, widths, strict=True):
            pad = " " * (w - _width(c))
            padded.append(pad + c if n else c + pad)
        return "  ".join(padded)

    yield line(out.header).rstrip()
    for number, row in enumerate(out.rows()):
        made = line([shown(c, options) if n else c for c, n in zip(row, numeric, strict=True)])
        yield f"\x1b[48;5;236m{made}\x1b[0m" if options.get("stripes") and stripes and number % 2 else made.rstrip()


def write_file(out: Output, path: str) -> None:
    """One CSV file: parts are written by all tasks to the shared folder, then put together in order."""
    spark = out.relation.df.sparkSession
    folder = shared_path(spark, "csv")
    write_csv(out, folder, header=False)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    store = hadoop.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in store.listStatus(hadoop.Path(folder)) if s.getPath().getName().startswith("part-"))
    files, root = store_of(folder)
    with open(path, "wb") as to:
        to.write(csv_line(out.header).encode() + b"\n")
        for name in names:
            with files.open_input_stream(f"{root}/{name}", compression=None) as part:
                while chunk := part.read(1 << 22):
                    to.write(chunk)
    remove(spark, folder)
