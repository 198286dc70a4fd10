"""A relation: a DataFrame with positional columns, their types, and the row order."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Value
from .errors import ScriptError, suggestion

_serial = itertools.count()


def fresh(prefix: str) -> str:
    """A physical name that no other column has."""
    return f"_{prefix}{next(_serial)}"


@dataclass(frozen=True)
class Field:
    name: str  # in the header; names may repeat
    physical: str  # in the DataFrame
    kind: str
    static: str | None = None

    def value(self) -> Value:
        return Value(self.kind, F.col(self.physical), self.static)


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    fields: list[Field]
    order: list[tuple[str, bool]] = field(default_factory=list)  # physical names, ascending
    row_number: str | None = None  # physical column that counts rows from 0 while none was dropped
    ordinal: str | None = None  # physical long column that gives the whole order by itself
    buckets: tuple[Column, ...] = ()  # what cuts the order into pieces of bounded size, first piece first
    files: tuple[str, ...] = ()  # of a scan of several files, where the order is (file, place): their paths, sorted

    @property
    def header(self) -> list[str]:
        return [f.name for f in self.fields]

    def with_(self, **changes) -> Relation:
        return replace(self, **changes)

    def sorted_by(self, order: list[tuple[str, bool]], **changes) -> Relation:
        """The relation in another order; what was known of the old one is forgotten."""
        return replace(self, **{"order": order, "row_number": None, "ordinal": None, "buckets": (), "files": (), **changes})

    def order_columns(self, reverse: bool = False) -> list[Column]:
        return [
            F.col(c).asc_nulls_last() if up != reverse else F.col(c).desc_nulls_first() for c, up in self.order
        ]

    def position(self, name: str, quoted: bool = False) -> int:
        """The first column of that name, else a 1-based position."""
        if name in self.header:
            return self.header.index(name)
        if name.isascii() and name.isdigit():
            if 1 <= int(name) <= len(self.fields):
                return int(name) - 1
            raise ScriptError(f"there is no column {name}; the input has {len(self.fields)}")
        raise ScriptError(f"unknown column '{name}'{suggestion(name, self.header)}")

    def get(self, name: str) -> Field:
        return self.fields[self.position(name)]

    def add(self, value: Value, prefix: str = "c") -> tuple[Relation, str]:
        """The relation with *value* in a new physical column."""
        physical = fresh(prefix)
        return self.with_(df=self.df.withColumn(physical, value.column)), physical


_NUMERIC = (T.DoubleType, T.FloatType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind_of(name: str, kind: T.DataType) -> str:
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, _WHOLE):
        return "int"
    if isinstance(kind, (*_NUMERIC, T.DecimalType)):
        return "num"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    raise ScriptError(f"column '{name}' has the type {kind.simpleString()}, which has no text form")
