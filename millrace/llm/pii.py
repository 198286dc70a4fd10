"""Personal data replaced by format-preserving Feistel pseudonyms.

Numbers and dates that validate (cards and IBANs by their check digits, addresses by
their ranges, dates by the calendar, …) are permuted by a keyed Feistel network within
their own format: digits stay digits, letters stay letters of their case, separators stay
in place, and what is made passes the validator that found it.  Equal values get equal
pseudonyms in every document under one key, so they stay linked, and no value maps to
itself: with f the Feistel permutation of n values, x becomes f^-1(f(x) + k mod n) for a
keyed k other than zero.  Each text is one row-local scan: nothing is shuffled or
collected.

The key is the caller's, or the session's setting ``spark.millrace.pii.key``; without
either it is drawn at random for the application, so that pseudonyms are linked within a
run and tell nobody anything outside it.

Defined cases: a null text stays null and has no findings; an empty text stays
empty; of overlapping candidates mail addresses win, then the leftmost, then the kind
named first in ``KINDS``; very long texts, and long runs of one kind of character, take
time in proportion; repeated rows become alike; an empty table gives an empty result; all
other columns pass through, and result columns win over input columns of the same name.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import worker_state

#: The session's setting that holds the key.
KEY_SETTING = "spark.millrace.pii.key"
ROUNDS = 8
CACHED_VALUES = 200_000

_FIRST_DAY, _LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
_DAYS = (_LAST_DAY - _FIRST_DAY).days + 1


class Permutation:
    """Keyed permutations of range(n), one for each n and tweak."""

    def __init__(self, key: str) -> None:
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()

    def _draw(self, n: int, tweak: str, turn: int, value: int) -> int:
        text = f"{tweak}|{n}|{turn}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=16 + n.bit_length() // 8).digest(), "big")

    def _sides(self, n: int) -> tuple[int, int]:
        a = max(2, int(n**0.5)) if n < 1 << 100 else 1 << (n.bit_length() // 2)
        return a, -(-n // a)

    def forward(self, x: int, n: int, tweak: str) -> int:
        a, b = self._sides(n)
        while True:  # walk the cycle until the value is in range again
            left, right = divmod(x, b)
            for turn in range(ROUNDS):
                if turn % 2 == 0:
                    left = (left + self._draw(n, tweak, turn, right)) % a
                else:
                    right = (right + self._draw(n, tweak, turn, left)) % b
            x = left * b + right
            if x < n:
                return x

    def backward(self, x: int, n: int, tweak: str) -> int:
        a, b = self._sides(n)
        while True:
            left, right = divmod(x, b)
            for turn in reversed(range(ROUNDS)):
                if turn % 2 == 0:
                    left = (left - self._draw(n, tweak, turn, right)) % a
                else:
                    right = (right - self._draw(n, tweak, turn, left)) % b
            x = left * b + right
            if x < n:
                return x

    def __call__(self, x: int, n: int, tweak: str) -> int:
        """A permutation of range(n) that leaves nothing in place (n > 1)."""
        if n < 2:
            return x
        step = 1 + self._draw(n, tweak, ROUNDS, 0) % (n - 1)
        return self.backward((self.forward(x, n, tweak) + step) % n, n, tweak)

    def shaped(self, text: str, tweak: str, hexadecimal: bool = False) -> str:
        """Permute digits and ASCII letters, each within its kind; the letters' case and all else stay.

        Texts that differ in case alone get pseudonyms that do.
        """
        letters = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
        at = [(i, _DIGITS if c in _DIGITS else letters) for i, c in enumerate(text.lower()) if c in _DIGITS or c in letters]
        low, value, n = text.lower(), 0, 1
        for i, kind in at:
            value, n = value * len(kind) + kind.index(low[i]), n * len(kind)
        shape = "".join("9" if kind is _DIGITS else "a" for _, kind in at)
        value = self(value, n, f"{tweak}{shape}")
        out = list(text)
        for i, kind in reversed(at):
            value, digit = divmod(value, len(kind))
            out[i] = kind[digit].upper() if text[i].isupper() else kind[digit]
        return "".join(out)


_DIGITS = "0123456789"


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(p: Permutation, m: re.Match) -> str | None:
    """A number whose check digit holds gets one whose check digit holds; others are no cards."""
    text = m.group()
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = p.shaped(digits[:-1], "card")
    new = iter(body + luhn_digit(body))
    return "".join(next(new) if c.isdigit() else c for c in text)


def _address(p: Permutation, m: re.Match) -> str | None:
    parts = m.group().split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in parts):
        return None
    value = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, p(value, 1 << 32, "ipv4").to_bytes(4, "big")))


def _email(p: Permutation, m: re.Match) -> str:
    local, host = m.group().rsplit("@", 1)
    if not re.search(r"[A-Za-z0-9]", local):
        local += "x"
    return p.shaped(local, f"mail{host.lower()}") + "@" + host


def _secret(p: Permutation, m: re.Match) -> str:
    return p.shaped(m.group(), "secret", hexadecimal=True)


def _phone(p: Permutation, m: re.Match) -> str | None:
    """8 to 15 digits after a country code, 10 else, not all alike; a leading digit stays what it is, zero or not."""
    text = m.group()
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15 or len(set(digits)) == 1:
        return None
    head = re.match(r"\+\d{1,3}[ .-]?", text)
    cut = head.end() if head else 0
    cells = [i for i in range(cut, len(text)) if text[i] in _DIGITS]
    plain = "".join(text[i] for i in cells)
    while True:  # walk the cycle until a number of the same kind comes
        plain = p.shaped(plain, "phone")
        if (plain[0] == "0") == (text[cells[0]] == "0") and len(set(plain)) > 1:
            break
    out = list(text)
    for i, c in zip(cells, plain, strict=True):
        out[i] = c
    return "".join(out) if "".join(out) != text else p.shaped(text, "phone again")


#: Areas, groups and serials that social security numbers have.
_AREAS = [a for a in range(1, 900) if a != 666]


def _social(p: Permutation, m: re.Match) -> str | None:
    area, group, serial = map(int, m.group().split("-"))
    if area not in _AREAS or not group or not serial:
        return None
    value = (_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1
    rest, serial = divmod(p(value, len(_AREAS) * 99 * 9999, "ssn"), 9999)
    area, group = divmod(rest, 99)
    return f"{_AREAS[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def iban_holds(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _iban(p: Permutation, m: re.Match) -> str | None:
    text = m.group()
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or not iban_holds(plain):
        return None
    body = p.shaped(plain[4:], f"iban{plain[:2]}")
    check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
    new = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _day(p: Permutation, year: int, month: int, day: int) -> date | None:
    try:
        old = date(year, month, day)
    except ValueError:
        return None
    if not _FIRST_DAY <= old <= _LAST_DAY:
        return None
    return _FIRST_DAY + timedelta(p((old - _FIRST_DAY).days, _DAYS, "date"))


def _date(p: Permutation, m: re.Match) -> str | None:
    a, gap, b, c = m.group("a", "gap", "b", "c")
    if len(a) == 4:
        new = _day(p, int(a), int(b), int(c))
        return new and f"{new.year:04d}{gap}{new.month:02d}{gap}{new.day:02d}"
    new = _day(p, int(c), int(b), int(a))  # day first; month first where only that is a date
    if new:
        return f"{new.day:02d}{gap}{new.month:02d}{gap}{new.year:04d}"
    new = _day(p, int(c), int(a), int(b))
    return new and f"{new.month:02d}{gap}{new.day:02d}{gap}{new.year:04d}"


#: kind, pattern (tried in this order at each place), validator and pseudonym.
KINDS: tuple[tuple[str, str, Callable[[Permutation, re.Match], str | None]], ...] = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", _email),  # found from its @
    ("secret", r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])", _secret),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?(?![0-9A-Za-z])", _iban),
    ("ipv4", r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)", _address),
    ("date", r"(?<!\d)(?P<a>\d{4}|\d{1,2})(?P<gap>[-/.])(?P<b>\d{1,2})(?P=gap)(?P<c>\d{4}|(?<=\d{4}[-/.]\d[-/.])\d{1,2}|(?<=\d{4}[-/.]\d\d[-/.])\d{1,2})(?![\d])", _date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _social),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])", _phone),
    ("card", r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)", _card),
)

#: Kinds that may swallow what follows: where the longest match does not validate,
#: shorter ones that end before a separator are tried.
SHORTENED = {"iban", "card"}

#: A text without these has nothing to find.
_HINT = re.compile(r"\d|@")
#: Where a kind other than a mail address may begin: never inside a run of digits, so that
#: a long run is tried once.
_START = re.compile(r"[(+](?=\d)|(?<!\d)\d|(?<![0-9A-Za-z])(?:[A-Z]{2}(?=\d\d)|[a-fA-F](?=[0-9a-fA-F]{31}))")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


class Pseudonyms:
    def __init__(self, key: str) -> None:
        self.permutation = Permutation(key)
        self.makers = {kind: (re.compile(pattern), make) for kind, pattern, make in KINDS}
        self.others = [kind for kind in self.makers if kind != "email"]
        self.known: dict[tuple[str, str], str | None] = {}

    def _make(self, kind: str, m: re.Match) -> str | None:
        at = kind, m.group()
        if at not in self.known:
            if len(self.known) >= CACHED_VALUES:
                self.known.clear()
            self.known[at] = self.makers[kind][1](self.permutation, m)
        return self.known[at]

    def _find(self, kind: str, text: str, start: int, stop: int) -> tuple[int, str] | None:
        """The end and the pseudonym of the longest valid match of *kind* at *start*, before *stop*."""
        pattern = self.makers[kind][0]
        m = pattern.match(text, start)
        while m:
            if m.end() <= stop and (new := self._make(kind, m)) is not None:
                return m.end(), new
            cut = max(text.rfind(gap, start, m.end()) for gap in " -") if kind in SHORTENED else -1
            m = pattern.match(text, start, cut) if cut > start else None
        return None

    def _addresses(self, text: str) -> list[tuple[int, int]]:
        """Where mail addresses stand, from each @ to both sides; none reaches into the one before."""
        found, low, at = [], 0, text.find("@")
        while at >= 0:
            if (host := _HOST.match(text, at)) and at > low and text[at - 1] in _LOCAL:
                start = at
                while start > low and text[start - 1] in _LOCAL:
                    start -= 1
                found.append((start, host.end()))
                low = host.end()
            else:
                low = at + 1
            at = text.find("@", max(at + 1, low))
        return found

    def replace(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds found in order."""
        if not _HINT.search(text):
            return text, []
        made: list[tuple[int, int, str, str]] = []
        pattern, at = self.makers["email"][0], 0
        for start, end in [*(self._addresses(text) if "@" in text else []), (len(text), len(text))]:
            while (c := _START.search(text, at, start)) and c.start() < start:
                at = c.start() + 1
                for kind in self.others:
                    if found := self._find(kind, text, c.start(), start):
                        made.append((c.start(), found[0], found[1], kind))
                        at = found[0]
                        break
            if end > start:
                made.append((start, end, self._make("email", pattern.match(text, start)), "email"))
            at = end
        out, done = [], 0
        for start, end, new, _ in made:
            out += [text[done:start], new]
            done = end
        return ("".join([*out, text[done:]]) if made else text), [kind for *_, kind in made]


_DRAWN: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The session's key; without the setting one that is drawn for the application."""
    return spark.conf.get(KEY_SETTING, None) or _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """All rows of *docs* with the text replaced, ``n_pii`` and ``pii_kinds`` (distinct, sorted)."""
    key = key or key_of(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_pii", "pii_kinds")]
    rows = docs.select(*own)
    position = own.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state()
        if ("pii", key) not in state:
            state["pii", key] = Pseudonyms(key)
        replace = state["pii", key].replace
        for batch in batches:
            texts, numbers, kinds = [], [], []
            for text in batch.column(position):
                new, found = replace(text.as_py()) if text.is_valid else (None, [])
                texts.append(new)
                numbers.append(len(found))
                kinds.append(",".join(sorted(set(found))))
            columns = batch.columns
            columns[position] = pa.array(texts, pa.string())
            columns += [pa.array(numbers, pa.int64()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "n_pii", "pii_kinds"])

    return rows.mapInArrow(run, f"{schema}, n_pii long, pii_kinds string")
