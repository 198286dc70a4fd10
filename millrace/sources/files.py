"""File scans: Parquet, CSV (a row is a line), and file patterns."""

from __future__ import annotations

import itertools
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.errors import ScriptError
from ..plans.relation import Field, Relation, fresh, kind_of

#: A pattern may stand for so many files at most.
MOST_FILES = 10_000


#: Rows, or bytes of CSV, of one piece of the scan order.
CHUNK_ROWS, CHUNK_BYTES = 1 << 20, 1 << 27
#: Files whose ranks are made a table of, for a place in the order that is one number.
MOST_RANKED = 100_000
_IN_TASK = (1 << 33) - 1


def _chunk(place: str, size: int) -> Column:
    return F.shiftright(F.col(place), size.bit_length() - 1)


def _row_places(files: list[str]) -> tuple[list[Column], dict]:
    """Hidden columns of a Parquet scan's order, and what a relation knows of it."""
    place = fresh("row")
    index = F.col("_metadata.row_index").alias(place)
    if len(files) == 1:
        return [index], {"order": [(place, True)], "row_number": place, "ordinal": place, "buckets": (_chunk(place, CHUNK_ROWS),)}
    file = fresh("file")
    known = {"order": [(file, True), (place, True)], "buckets": (F.col(file), _chunk(place, CHUNK_ROWS))}
    return [F.col("_metadata.file_path").alias(file), index], known | {"files": tuple(sorted(files)) if len(files) <= MOST_RANKED else ()}


def _line_places(files: list[str]) -> tuple[list[Column], dict]:
    """Hidden columns of a line scan's order.

    A task numbers its lines, which is the order inside a split.  A line has a byte at
    least, so in a scan of one file the split's start plus that number rises too.
    """
    line = F.monotonically_increasing_id()
    start = F.col("_metadata.file_block_start")
    if len(files) == 1:
        place = fresh("row")
        made = (start + line.bitwiseAND(F.lit(_IN_TASK))).alias(place)
        return [made], {"order": [(place, True)], "ordinal": place, "buckets": (_chunk(place, CHUNK_BYTES),)}
    file, split, place = fresh("file"), fresh("split"), fresh("row")
    known = {"order": [(file, True), (split, True), (place, True)], "buckets": (F.col(file), F.col(split))}
    return [F.col("_metadata.file_path").alias(file), start.alias(split), line.alias(place)], known


def from_frame(df: DataFrame) -> Relation:
    """A relation over any DataFrame; its rows have no order unless sorted."""
    fields = [Field(f.name, fresh("c"), kind_of(f.name, f.dataType)) for f in df.schema]
    named = df.toDF(*(f.physical for f in fields))
    return Relation(_doubles(named, fields), fields)


def _doubles(df: DataFrame, fields: list[Field]) -> DataFrame:
    kinds = dict(df.dtypes)
    wide = {f.physical: F.col(f.physical).cast("double") for f in fields if f.kind == "num" and kinds[f.physical] != "double"}
    return df.withColumns(wide) if wide else df


def scan_parquet(spark: SparkSession, path: str) -> Relation:
    df = spark.read.parquet(path)
    fields = [Field(f.name, fresh("c"), kind_of(f.name, f.dataType)) for f in df.schema]
    places, known = _row_places(df.inputFiles())
    scan = df.select(*(F.col(f"`{f.name}`").alias(f.physical) for f in fields), *places)
    return Relation(_doubles(scan, fields), fields, **known)


#: Cell after cell from the line's start: a quoted one with what follows it, or another.
_CELLS = r'\G(,?)(?:("(?:[^"]|"")*")[^,]*|([^,]*))'


def scan_csv(spark: SparkSession, path: str, header: str | None = None) -> Relation:
    """Lines split by commas; ``"`` quotes, no row spans lines; short rows read as blank cells."""
    reader = spark.read.option("lineSep", "\n")
    source = reader.text(path)
    found = sorted(source.inputFiles())
    places, known = _line_places(found)
    order = known["order"]
    lines = source.select(F.regexp_replace("value", "\r$", "").alias("_line"), *places)
    if header is None or header == "-":
        # the first split of a file comes first among splits of its size
        top = reader.text(found[0]).first() if found else None
        if top is None:
            raise ScriptError(f"{path} is empty; its first line should name the columns")
        cells = split_line(top["value"].removesuffix("\r"))
        names = cells if header is None else [f"c{i + 1}" for i in range(len(cells))]
    else:
        names = split_line(header)
    if header is None:
        if len(found) == 1:
            lines = lines.filter(F.col(order[0][0]) != 0)
        else:
            file, split, place = (c for c, _ in order)
            heads = lines.filter(F.col(split) == 0).groupBy(file).agg(F.min(place).alias("_head"))
            is_head = F.col("_head").eqNullSafe(F.col(place)) & (F.col(split) == 0)
            # cells read both sides of the join: else what is asked of them is asked below it, of the headers too
            lines = lines.join(heads, file, "left").filter(~is_head).withColumn("_line", F.when(~is_head, F.col("_line")))
    fields = [Field(n, fresh("c"), "text") for n in names]
    schema = ", ".join(f"{f.physical} string" for f in fields)
    options = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\x01", "mode": "PERMISSIVE"}
    # what follows a closing quote inside its cell is dropped
    plain = F.when(F.col("_line").rlike('"[^",]'), F.regexp_replace("_line", _CELLS, "$1$2$3")).otherwise(F.col("_line"))
    valid = F.when(F.is_valid_utf8("_line"), plain).otherwise(F.raise_error(F.lit("the input is not valid UTF-8")).cast("string"))
    cells = lines.select(F.from_csv(valid, schema, options).alias("_row"), *(c for c, _ in order))
    kept = [F.coalesce(F.col(f"_row.{f.physical}"), F.lit("")).alias(f.physical) for f in fields]
    return Relation(cells.select(*kept, *(c for c, _ in order)), fields, **known)


def split_line(line: str) -> list[str]:
    """The cells of one CSV line."""
    cells, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)("?)[^,]*').match(line, i)
            cells.append(m[1].replace('""', '"'))
        else:
            m = re.compile(r"[^,]*").match(line, i)
            cells.append(m[0])
        i = m.end() + 1
        if i > len(line):
            return cells


def scan(spark: SparkSession, path: str, header: str | None = None, kind: str | None = None) -> Relation:
    if kind == "parquet" or (kind is None and path.lower().rstrip("/").endswith(".parquet")):
        if header is not None:
            raise ScriptError("a Parquet input has its own column names")
        return scan_parquet(spark, path)
    return scan_csv(spark, path, header)


def _alternatives(body: str) -> list[str] | None:
    """The texts of one brace group: words, or ranges that count up or down."""
    out = []
    for part in body.split(","):
        m = re.fullmatch(r"(-?\d+)\.\.(-?\d+)|([A-Za-z])\.\.([A-Za-z])", part)
        if m and m[1] is not None:
            a, b = int(m[1]), int(m[2])
            width = max(len(m[1]), len(m[2])) if m[1].startswith("0") or m[2].startswith("0") else 0
            out += [f"{n:0{width}d}" for n in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
        elif m:
            a, b = ord(m[3]), ord(m[4])
            out += [chr(n) for n in range(a, b + (1 if b >= a else -1), 1 if b >= a else -1)]
        else:
            out.append(part)
    return out if len(out) > 1 or ".." in body else None


def _natural(text: str) -> list:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", text) if p]


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder of this machine, or of any store that Spark reads."""
    if "://" not in folder:
        return os.listdir(folder or ".")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []


def _exists(spark: SparkSession, path: str) -> bool:
    if "://" not in path:
        return os.path.exists(path)
    folder, _, name = path.rpartition("/")
    return name in _listed(spark, folder)


def expand(spark: SparkSession, pattern: str, folder: str = ".") -> list[tuple[str, str]]:
    """(file, part) for each file of a pattern; part joins what braces and wildcards stood for."""
    pieces = re.split(r"\{([^{}]*)\}", pattern)
    choices = [[(p, None)] if i % 2 == 0 else [(a, a) for a in (_alternatives(p) or [p])] for i, p in enumerate(pieces)]
    found: list[tuple[str, str]] = []
    for combination in itertools.product(*choices):
        name = "".join(text for text, _ in combination)
        said = [part for _, part in combination if part]
        if not re.search(r"[*?]", name):
            path = name if "://" in name else os.path.join(folder, name)
            if len(pieces) > 1 and not _exists(spark, path):
                raise ScriptError(f"no file '{name}'")
            found.append((path, "_".join(said)))
            continue
        directory, base = os.path.split(name if "://" in name else os.path.join(folder, name))
        if re.search(r"[*?]", directory):
            raise ScriptError("wildcards go in the file name only")
        shape = re.compile("".join("(.*)" if c == "*" else "(.)" if c == "?" else re.escape(c) for c in base), re.S)
        here = sorted((f for f in _listed(spark, directory) if not f.startswith(".") or base.startswith(".")), key=_natural)
        for f in here:
            if m := shape.fullmatch(f):
                found.append((os.path.join(directory, f), "_".join([*said, *(g for g in m.groups() if g)])))
    if not found:
        raise ScriptError(f"no file matches '{pattern}'")
    if len(found) > MOST_FILES:
        raise ScriptError(f"'{pattern}' stands for more than {MOST_FILES} files")
    for what in (0, 1):
        if len({x[what] for x in found}) < len(found):
            raise ScriptError(f"'{pattern}' names a file or a part twice")
    return found


def is_pattern(spark: SparkSession, name: str) -> bool:
    return bool(re.search(r"[*?]|\{[^{}]*(,|\.\.)[^{}]*\}", name)) and not _exists(spark, name)
