"""Cells as Spark columns: text, numbers, and how each reads as the other."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number grammar of cells.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"
_EDGES = r"(?U)^\s+|\s+$"
#: Whole numbers below this print as integers.
WHOLE = 1e15


def format_number(v: float | None) -> str | None:
    """Text of a number: integers plain, else 15 significant digits, 6 to 17 of them decimals."""
    if v is None:
        return None
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "inf" if v > 0 else "-inf"
    if v == int(v) and abs(v) < WHOLE:
        return "-0" if v == 0 and math.copysign(1, v) < 0 else str(int(v))
    exponent = int(f"{abs(v):.17e}".split("e")[1])
    text = f"{v:.{max(0, min(max(14 - exponent, 6), 16 - exponent))}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def parsed(text: Column) -> Column:
    """The number in a text, or null."""
    t = trimmed(text)
    nan = F.lower(t).isin("nan", "+nan", "-nan")
    return F.when(nan, F.lit(float("nan"))).when(t.rlike(NUMBER), t.try_cast("double"))


#: From the least to the most, 15 significant digits take so many decimals at most; ten
#: to the power of each of them is a double exactly.
_LEAST_SCALED, _MOST_SCALED, _SCALED_DECIMALS = 1e-7, 1e9, 21


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind *value* once for *body*: written out again it would be evaluated, and compiled, again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pick(choices: list, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in choices)), at + 1)


def _trimmed_fraction(whole: Column, fraction: Column) -> Column:
    return _let(F.rtrim(fraction, F.lit("0")), lambda kept: F.when(kept == "", whole).otherwise(F.concat(whole, F.lit("."), kept)))


def _scaled_text(a: Column) -> Column:
    """The text of 15 significant digits, for _LEAST_SCALED <= a < _MOST_SCALED.

    The scaled number is below 2^50, where halves are doubles, so that the rounded product
    lies on the side of a half on which the exact one does.  Only where it is the half
    itself are exact integers compared.
    """

    def half_up(low: Column, decimals: Column) -> Column:
        # a = mantissa / 2^bits: compare mantissa * 10^decimals with (2 low + 1) * 2^(bits - 1)
        bits = (F.lit(53) - F.floor(F.log2(a))).cast("int")
        mantissa = (a * F.pow(F.lit(2.0), bits)).cast("bigint").cast("decimal(38,0)")
        exact = mantissa * _pick([Decimal(10**d) for d in range(_SCALED_DECIMALS + 1)], decimals).cast("decimal(38,0)")
        half = (low * 2 + 1).cast("decimal(38,0)") * _pick([Decimal(2**b) for b in range(90)], bits - 1).cast("decimal(38,0)")
        return F.when(exact == half, low % 2 == 1).otherwise(exact > half)

    def placed(digits: Column, decimals: Column) -> Column:
        cut = F.length(digits) - decimals
        return _trimmed_fraction(F.substring(digits, F.lit(1), cut), F.substring(digits, cut + 1, decimals))

    def rounded(scaled: Column, decimals: Column) -> Column:
        low = F.floor(scaled)
        over = scaled - low
        up = F.when(over != 0.5, over > 0.5).otherwise(half_up(low, decimals))
        digits = (low + up.cast("bigint")).cast("string")
        return _let(F.lpad(digits, F.greatest(F.length(digits), decimals + 1), "0"), lambda padded: placed(padded, decimals))

    decimals = F.lit(_SCALED_DECIMALS)
    for e in range(-6, 9):  # the last test made is the outermost
        decimals = F.when(a >= float(f"1e{e}"), 14 - e).otherwise(decimals)
    powers = [float(10**d) for d in range(_SCALED_DECIMALS + 1)]
    return _let(decimals, lambda d: _let(a * _pick(powers, d), lambda scaled: rounded(scaled, d)))


def _large_text(a: Column) -> Column:
    """The text for _MOST_SCALED <= a < 2^63: the fraction has few bits, so that its products are exact."""
    decimals = F.when(a < 1e11, 6).when(a < 1e12, 5).when(a < 1e13, 4).when(a < 1e14, 3).when(a < 1e15, 2).when(a < 1e16, 1).otherwise(0)

    def placed(part: Column, unit: Column) -> Column:
        carry = part == unit
        digits = F.lpad(F.when(carry, 0).otherwise(part).cast("bigint").cast("string"), F.length(unit.cast("bigint").cast("string")) - 1, "0")
        return _trimmed_fraction((F.floor(a) + carry.cast("bigint")).cast("string"), digits)

    return _let(F.pow(F.lit(10.0), decimals), lambda unit: _let(F.rint((a - F.floor(a)) * unit), lambda part: placed(part, unit)))


def _extreme_text(a: Column) -> Column:
    """The text for a < 1e-7, and for 2^63 and more.

    Up to 1e38 all digits are exact.  Beyond, and below 1e-7, they are those of the shortest
    text that reads as the number, rounded half up; zeros fill the rest.
    """
    bits = F.floor(F.log2(a)).cast("int") - 53
    mantissa = (a / F.pow(F.lit(2.0), bits)).cast("bigint").cast("decimal(38,0)")
    whole = mantissa * _pick([Decimal(2**b) for b in range(75)], bits).cast("decimal(38,0)")
    shown = F.format_string("%.14e", a)
    digits = F.concat(F.substring(shown, 1, 1), F.substring(shown, 3, 14))
    zeros = -F.substring_index(shown, "e", -1).cast("int") - 1
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), zeros), F.rtrim(digits, F.lit("0")))
    return F.when(a < 1, small).when(a < 1e37, whole.cast("string")).otherwise(F.format_string("%.0f", a))


def formatted(number: Column) -> Column:
    """Text of a number, by native expressions; see ``format_number``."""

    def text(n: Column) -> Column:
        return F.concat(F.when(n < 0, "-").otherwise(""), _let(F.abs(n), of_size))

    def of_size(a: Column) -> Column:
        scaled = F.when((a >= _LEAST_SCALED) & (a < _MOST_SCALED), _scaled_text(a))
        return scaled.when((a >= _MOST_SCALED) & (a < 2.0**63), _large_text(a)).otherwise(_extreme_text(a))

    whole = (number == F.rint(number)) & (F.abs(number) < WHOLE) & (number != 0)
    # a text of at most 15 digits that reads as the number is its rounding to 15 digits
    short = (F.abs(number) >= 1e-3) & (F.abs(number) < 1e7) & (F.length(number.cast("string")) <= 16)
    return (
        F.when(whole, number.cast("bigint").cast("string"))
        .when(short, F.rtrim(number.cast("string"), F.lit("0")))
        .when(number == 0, F.when(number.cast("string") == "-0.0", "-0").otherwise("0"))
        .when(F.isnan(number), "NaN")
        .when(F.abs(number) == float("inf"), F.when(number > 0, "inf").otherwise("-inf"))
        .when(number.isNotNull(), _let(number, text))
    )


@dataclass(frozen=True)
class Value:
    """A cell expression.

    ``kind``: ``text``; ``num`` (a double, null when blank); ``int`` (an integer type,
    null when blank); ``time`` and ``bool``, kept as they are; ``mixed`` (struct of
    number n, else text s).  ``static`` is the type known without looking at rows.
    """

    kind: str
    column: Column
    static: str | None = None

    def text(self) -> Column:
        c = self.column
        if self.kind == "text":
            return F.coalesce(c, F.lit(""))
        if self.kind == "int":
            return F.coalesce(c.cast("string"), F.lit(""))
        if self.kind == "bool":
            return F.when(c, "t").when(~c, "f").otherwise("")
        if self.kind == "time":
            plain = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
            micros = F.date_format(c, "SSSSSS")
            return F.coalesce(F.when(micros == "000000", plain).otherwise(F.concat(plain, F.lit("."), micros)), F.lit(""))
        if self.kind == "mixed":
            return F.coalesce(formatted(c["n"]), c["s"], F.lit(""))
        return F.coalesce(formatted(c), F.lit(""))

    def optional(self) -> Column:
        """The number, or null for blank and other text."""
        if self.kind == "num":
            return self.column
        if self.kind == "int":
            return self.column.cast("double")
        if self.kind == "mixed":
            return F.coalesce(self.column["n"], parsed(self.column["s"]))
        return parsed(self.text())

    def blank(self) -> Column:
        """True for a cell of white space only."""
        if self.kind in ("num", "int"):
            return self.column.isNull()
        return trimmed(self.text()) == ""

    def soft(self) -> Column:
        """The number, 0 for blank, null for other text."""
        if self.kind in ("num", "int"):
            return F.coalesce(self.optional(), F.lit(0.0))
        return F.coalesce(self.optional(), F.when(self.blank(), F.lit(0.0)))

    def bad(self) -> Column | None:
        """True where the number is needed and the text is none; None if that cannot be."""
        if self.kind in ("num", "int"):
            return None
        return self.soft().isNull()

    def number(self) -> Column:
        """The number; other text stops the run."""
        if self.kind in ("num", "int"):
            return self.soft()
        complaint = F.raise_error(F.concat(F.lit("not a number: '"), self.text(), F.lit("'"))).cast("double")
        return F.coalesce(self.soft(), complaint)

    def as_mixed(self) -> Value:
        if self.kind == "mixed":
            return self
        number = self.optional() if self.kind in ("num", "int") else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if self.kind in ("num", "int") else self.text()
        return Value("mixed", F.struct(number.alias("n"), text.alias("s")), self.static)


def ieee(compare: Callable[[Column, Column], Column], left: Column, right: Column, unequal: bool = False) -> Column:
    """Compare doubles as IEEE does: with NaN nothing holds but '!='."""
    nan = F.isnan(left) | F.isnan(right)
    return F.when(nan, F.lit(unequal)).otherwise(compare(left, right))


def _small(x: Column, f: Callable[[Column], Column]) -> Column:
    """Round with a function that goes through long integers, keeping what is whole already."""
    return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(f(x).cast("double"))


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(f(x))


MATH: dict[str, Callable[[Column], Column]] = {
    "round": lambda x: _small(x, lambda v: F.signum(v) * F.floor(F.abs(v) + 0.5)),
    "floor": lambda x: _small(x, F.floor),
    "ceil": lambda x: _small(x, F.ceil),
    "int": lambda x: _small(x, lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))),
    "abs": F.abs,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": _log(F.log),
    "log10": _log(F.log10),
    "log2": _log(F.log2),
    "sign": lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x)),
}


def power(x: Column, y: Column) -> Column:
    one = (x == 1) | (y == 0) | ((x == -1) & (F.abs(y) == float("inf")))
    return F.when(one, F.lit(1.0)).otherwise(F.pow(x, y))


def extreme(values: list[Column], largest: bool) -> Column:
    """Least or greatest, NaN left out unless there is nothing else."""
    pick = F.greatest if largest else F.least
    known = [F.when(~F.isnan(v), v) for v in values]
    found = pick(*known) if len(known) > 1 else known[0]
    return F.coalesce(found, F.lit(float("nan")))
