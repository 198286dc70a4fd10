"""Search patterns: linear-time dialect with Unicode classes, to the JVM's dialect."""

from __future__ import annotations

import re

from ..plans.errors import ScriptError

# Ranges of the ASCII classes written [:name:], and short names of the
# general categories of characters.
_ASCII = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t-\r ",
    "upper": "A-Z", "word": "0-9A-Z_a-z", "xdigit": "0-9A-Fa-f",
}
_CATEGORY = {
    "letter": "L", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd",
    "letternumber": "Nl", "othernumber": "No", "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd",
    "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z",
    "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp", "other": "C", "control": "Cc", "format": "Cf",
}

_GROUP = re.compile(r"\(\?(?:P?<(?P<name>[A-Za-z_][\w.]*)>|(?P<flags>[a-zA-Z]*(?:-[a-zA-Z]+)?)(?P<end>[:)]))")
_PROPERTY = re.compile(r"([pP])(?:\{(\^?)([^}]*)\}|(\w))")
_REPEAT = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")


def _property(m: re.Match) -> str:
    letter, negated, name = m[1], bool(m[2]), m[3] if m[3] is not None else m[4]
    if negated:
        letter = "P" if letter == "p" else "p"
    kind, _, value = name.rpartition("=")
    plain = re.sub(r"[\s_-]", "", value).lower()
    if plain == "any":
        return r"[\x{0}-\x{10FFFF}]"
    if kind.lower() in ("script", "sc", "scx", "script_extensions"):
        return f"\\{letter}{{IsScript_{value}}}".replace("IsScript_", "Is")
    category = _CATEGORY.get(plain) or (value if len(value) <= 2 else None)
    return f"\\{letter}{{{category or 'Is' + value}}}"


def _escape(pattern: str, i: int, in_class: bool) -> tuple[str, int]:
    """What stands for the escape at *i*, and where it ends."""
    c = pattern[i + 1 : i + 2]
    if c and c in "pP" and (m := _PROPERTY.match(pattern, i + 1)):
        return _property(m), m.end()
    if m := re.compile(r"\\[uU](?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{8}|[0-9A-Fa-f]{4}))").match(pattern, i):
        return f"\\x{{{m[1] or m[2]}}}", m.end()
    if c == "v":
        return r"\x0B", i + 2
    if c == "x" or (c and c in "dDwWsStnrfa") or (c and not c.isalnum() and c not in "<>"):
        return pattern[i : i + 2], i + 2
    if not in_class and c and c in "bBAz" and pattern[i + 2 : i + 3] != "{":
        return pattern[i : i + 2], i + 2
    if not in_class and c and c in "<>":
        return (r"\b(?=\w)" if c == "<" else r"\b(?<=\w)"), i + 2
    raise ScriptError(f"a pattern has no '\\{c}'")


def _class(pattern: str, i: int) -> tuple[str, int]:
    """The bracketed class that opens at *i*, and where it ends."""
    out, j = "[", i + 1
    if pattern[j : j + 1] == "^":
        out, j = "[^", j + 1
    if pattern[j : j + 1] == "]":
        out, j = out + r"\]", j + 1
    while j < len(pattern):
        c = pattern[j]
        if c == "]":
            return out + "]", j + 1
        if m := re.compile(r"\[:(\^?)(\w+):\]").match(pattern, j):
            if m[2] not in _ASCII:
                raise ScriptError(f"a pattern has no class '{m[0]}'")
            out, j = out + (f"[^{_ASCII[m[2]]}]" if m[1] else _ASCII[m[2]]), m.end()
        elif c == "[":
            inner, j = _class(pattern, j)
            out += inner
        elif c == "\\":
            inner, j = _escape(pattern, j, True)
            out += inner
        elif pattern[j : j + 2] in ("--", "~~"):
            raise ScriptError("a pattern's class has no '--' or '~~'")
        else:
            out, j = out + c, j + 1
    raise ScriptError("a pattern's class is not closed")


def jvm_pattern(pattern: str) -> str:
    """The pattern for the JVM: Unicode classes, only a line feed ends a line, '$' is the very end."""
    lines = any("m" in (m["flags"] or "").partition("-")[0] for m in _GROUP.finditer(pattern))
    out, i, repeated = [], 0, False
    while i < len(pattern):
        c, again = pattern[i], False
        if c == "\\":
            made, i = _escape(pattern, i, False)
        elif c == "[":
            made, i = _class(pattern, i)
        elif pattern.startswith("(?", i):
            m = _GROUP.match(pattern, i)
            if not m:
                raise ScriptError("patterns have no look-around, atomic groups or conditions")
            if m["name"]:
                made = "("
            else:
                if set(m["flags"]) - set("imsxu-"):
                    raise ScriptError(f"a pattern has no flags '{m['flags']}'")
                made = f"(?{m['flags'].replace('u', 'U')}{m['end']}"
            i = m.end()
        elif m := _REPEAT.match(pattern, i):
            lazy = c == "?" and repeated
            if repeated and not lazy:
                raise ScriptError("a pattern repeats a repeat; put the inner one in a group")
            made, i, again = m[0], m.end(), not lazy
        else:
            made, i = (r"\z" if c == "$" and not lines else c), i + 1
        repeated = again
        out.append(made)
    return "(?Ud)" + "".join(out)
