"""Scripts: comments, fragments, stages and their arguments, to a list of stages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from .errors import ScriptError, suggestion
from .expr import Node, Parser

VERBS = "cols select sort head tail stats uniq color rename fmt from join add agg graph".split()
AGGREGATES = ("count", "count_distinct", "sum", "min", "max", "mean", "stddev")
_ALIAS = {"avg": "mean", "std": "stddev"}
#: Verbs of other dialects and what does their work here.
ADVICE = {
    "to-num": "add NAME = num(COL)", "to-str": "add NAME = str(COL)", "delta": "add NAME = COL - prev(COL)",
    "group": "agg FN(COL) by KEYS", "hdr": "rename OLD=NEW, or the option --header", "filter": "select EXPR", "where": "select EXPR",
}
_OPEN, _CLOSE = "([{", ")]}"
DEPTH = 64


@dataclass
class Stage:
    verb: str
    text: str
    args: dict[str, Any] = field(default_factory=dict)


@dataclass
class Fragment:
    params: list[str]
    body: str


def strip_comments(text: str) -> str:
    out, quote = [], ""
    for c in text:
        if quote == "#":
            quote = "" if c == "\n" else quote
            out.append(c if c == "\n" else " ")
        elif quote:
            quote = "" if c == quote else quote
            out.append(c)
        elif c == "#":
            quote = "#"
            out.append(" ")
        else:
            quote = c if c in "'\"`" else ""
            out.append(c)
    if quote in ("'", '"', "`") and quote:
        raise ScriptError(f"unclosed {quote}", text, len(text) - 1)
    return "".join(out)


def split_top(text: str, separators: str) -> list[str]:
    """Cut at separators outside quotes and brackets; '||' is no separator."""
    parts, start, depth, quote, i = [], 0, 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
            if depth < 0:
                raise ScriptError(f"unexpected '{c}'", text, i)
        elif c == "|" and text[i : i + 2] == "||":
            i += 1
        elif depth == 0 and c in separators:
            parts.append(text[start:i])
            start = i + 1
        i += 1
    if depth:
        raise ScriptError("unclosed bracket", text, len(text) - 1)
    return [*parts, text[start:]]


def items(text: str) -> list[tuple[str, bool]]:
    """Comma- or blank-separated list items with whether they were quoted; blanks round '=' bind."""
    text = re.sub(r"\s*=\s*", "=", text)
    out, current, quoted, i = [], "", False, 0
    while i < len(text):
        c = text[i]
        if c in "`'\"":
            end = text.index(c, i + 1)
            current, quoted, i = current + text[i + 1 : end], True, end
        elif c in ", \t\n\r":
            if current or quoted:
                out.append((current, quoted))
            current, quoted = "", False
        else:
            current += c
        i += 1
    if current or quoted:
        out.append((current, quoted))
    return out


def names(text: str) -> list[str]:
    return [n for n, _ in items(text)]


def parse(script: str) -> list[Stage]:
    """The stages of a script with all fragments expanded."""
    text = strip_comments(script)
    fragments: dict[str, Fragment] = {}
    while m := re.match(r"\s*fn\s+(\w+)\s*\(([^)]*)\)\s*\{", text):
        name, params = m[1], [p for p in re.split(r"[,\s]+", m[2]) if p]
        i = _closing(text, m.end() - 1) + 1
        if name in fragments or name in VERBS or name == "fn":
            raise ScriptError(f"'{name}' is defined already", text, m.start(1))
        if len(set(params)) < len(params):
            raise ScriptError(f"fragment '{name}' names a parameter twice", text, m.start(2))
        fragments[name] = Fragment(params, text[m.end() : i - 1])
        text = text[i:]
    return stages(text, fragments, 0)


def stages(text: str, fragments: dict[str, Fragment], depth: int) -> list[Stage]:
    if depth > DEPTH:
        raise ScriptError("fragments call each other too deeply")
    out: list[Stage] = []
    if not text.strip():
        return out
    for part in split_top(text, "|"):
        if not part.strip():
            raise ScriptError("empty stage", text, 0)
        call = re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", part, re.S)
        if call and call[1] in fragments:
            out += stages(_expand(call[1], fragments[call[1]], call[2]), fragments, depth + 1)
            continue
        verb, rest = re.fullmatch(r"\s*(\w*)\s?(.*)", part, re.S).groups()
        spelled = re.match(r"\s*([\w-]*)", part)[1]
        if spelled in ADVICE and spelled not in fragments:
            raise ScriptError(f"there is no command '{spelled}'; write: {ADVICE[spelled]}", part, 0)
        if verb not in VERBS:
            raise ScriptError(f"unknown command '{verb}'{suggestion(verb, [*VERBS, *fragments])}", part, 0)
        out.append(Stage(verb, part.strip(), PARSERS[verb](rest, fragments, depth)))
    return out


def _expand(name: str, fragment: Fragment, given: str) -> str:
    args = [a.strip() for a in split_top(given, ",")] if given.strip() else []
    if len(args) != len(fragment.params):
        raise ScriptError(f"fragment '{name}' takes {len(fragment.params)} argument(s), {len(args)} given")
    values = dict(zip(fragment.params, args, strict=True))
    piece = re.compile(r"'[^']*'|\"[^\"]*\"|`[^`]*`|[^\W\d]\w*")
    return piece.sub(lambda m: values.get(m[0], m[0]), fragment.body)


def _flags(rest: str, known: dict[str, str]) -> tuple[dict[str, Any], str]:
    """Leading flags: known maps a spelling to 'name' or 'name=' (takes a value)."""
    found: dict[str, Any] = {}
    while m := re.match(r"\s*(--?[A-Za-z][\w-]*)(=|\s+|(?=\d)|$)", rest):
        name = known.get(m[1])
        if name is None:
            break
        rest = rest[m.end() :]
        if not name.endswith("="):
            found[name] = True
            continue
        value = re.match(r"\s*('[^']*'|\"[^\"]*\"|[^\s,]+)", rest)
        if not value:
            raise ScriptError(f"{m[1]} needs a value")
        found[name[:-1]] = value[1].strip("'\"")
        rest = rest[value.end() :]
    return found, rest


def _number(text: str, what: str) -> int:
    try:
        return int(text)
    except ValueError:
        raise ScriptError(f"{what} takes a number, not '{text}'") from None


def _cols(rest, fragments, depth):
    drop = re.match(r"\s*-v\b", rest)
    chosen = items(rest[drop.end() :] if drop else rest)
    if not chosen:
        raise ScriptError("cols needs columns")
    return {"drop": bool(drop), "columns": chosen}


def _select(rest, fragments, depth):
    found: dict[str, Any] = {"invert": False, "before": 0, "after": 0}
    while m := re.match(r"\s*(-v\b|-([AB])\s*(\d+))", rest):
        if m[2]:
            found["after" if m[2] == "A" else "before"] = int(m[3])
        else:
            found["invert"] = True
        rest = rest[m.end() :]
    parser = Parser(rest, fragments=frozenset(fragments))
    return found | {"expr": parser.condition(parser.whole())}


def _sort(rest, fragments, depth):
    keys = []
    for text, _ in items(rest):
        name, _, flags = text.partition("=")
        if set(flags) - set("nsr") or {"n", "s"} <= set(flags):
            raise ScriptError(f"sort flags are n or s, and r, not '{flags}'")
        keys.append((name, "n" if "n" in flags else "s" if "s" in flags else "", "r" in flags))
    if not keys:
        raise ScriptError("sort needs columns")
    return {"keys": keys}


def _count_of(rest: str) -> str:
    text = re.sub(r"^\s*(-n|--lines)[\s=]*", "", rest.strip())
    return text.strip()


def _head(rest, fragments, depth):
    flagged = bool(re.match(r"\s*(-n|--lines)", rest))
    n = _number(_count_of(rest) or "10", "head")
    if n < 0 and not flagged:
        n = -n
    return {"first": n} if n >= 0 else {"but_last": -n}


def _tail(rest, fragments, depth):
    text = _count_of(rest) or "10"
    if text.startswith("+"):
        return {"from": max(1, _number(text[1:], "tail"))}
    n = _number(text, "tail")
    if n < 0 and re.match(r"\s*(-n|--lines)", rest):
        raise ScriptError("tail takes no negative count")
    return {"last": abs(n)}


def _columns(rest, fragments, depth):
    return {"columns": names(rest)}


def _rename(rest, fragments, depth):
    pairs = [t.partition("=") for t, _ in items(rest)]
    if not pairs or any(not (a and eq and b) for a, eq, b in pairs):
        raise ScriptError("rename takes OLD=NEW")
    return {"pairs": [(a, b) for a, _, b in pairs]}


def _add(rest, fragments, depth):
    m = re.match(r"\s*(`[^`]*`|'[^']*'|\"[^\"]*\"|[^\s=]+)\s*=(?!=)", rest)
    if not m:
        raise ScriptError("add takes NAME = EXPR")
    return {"name": m[1].strip("`'\""), "quoted": m[1][0] in "`'\"", "expr": Parser(rest[m.end() :], fragments=frozenset(fragments)).whole()}


def _agg(rest, fragments, depth):
    m = re.search(r"(?:^|[\s,)])by\s+([^()]*)$", rest)
    keys = names(m[1]) if m else []
    spec = rest[: m.start() + (rest[m.start()] == ")")] if m else rest
    out = []
    for name, fn, col in re.findall(r"(?:(`[^`]*`|[^\s,=()]+)\s*=\s*)?(\w+)\s*(?:\(([^()]*)\))?\s*(?:,|\s|$)", spec):
        fn = _ALIAS.get(fn, fn)
        if fn not in AGGREGATES:
            raise ScriptError(f"unknown aggregate '{fn}'{suggestion(fn, list(AGGREGATES))}")
        if not col.strip() and fn != "count":
            raise ScriptError(f"{fn} needs a column")
        out.append((name.strip("`"), fn, col.strip().strip("`'\"")))
    if not out:
        raise ScriptError("agg needs an aggregate")
    return {"aggregates": out, "keys": keys}


def _files(text: str, fragments, depth: int) -> list[dict[str, Any]]:
    found = []
    for part in split_top(text, ","):
        if not part.strip():
            continue
        sub = None
        part = part.strip()
        if part.startswith("("):
            close = _closing(part)
            sub, part = stages(part[1:close], fragments, depth + 1), part[close + 1 :].strip()
        flags, part = _flags(part, {"-L": "left_suffix=", "-R": "right_suffix="})
        m = re.fullmatch(r"('[^']*'|\"[^\"]*\"|\S+)\s*(.*?)", part, re.S)
        on = None
        name = m[1] if m else part
        tail = m[2] if m else ""
        if k := re.match(r"on\s+(.*)", tail, re.S):
            on = names(k[1])
        elif tail:
            flags2, rest = _flags(tail, {"-L": "left_suffix=", "-R": "right_suffix="})
            flags |= flags2
            if k := re.match(r"\s*on\s+(.*)", rest, re.S):
                on = names(k[1])
            elif rest.strip():
                raise ScriptError(f"unexpected '{rest.strip()}' after the file")
        if name == "-":
            raise ScriptError("a joined or named input is a file, not standard input")
        found.append({"sub": sub, "file": name.strip("'\""), "literal": name[:1] in "'\"", "on": on, **flags})
    return found


def _closing(text: str, at: int = 0) -> int:
    """Where the bracket that opens at *at* is closed; quoted ones do not count."""
    depth, quote = 0, ""
    for i, c in enumerate(text[at:], at):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        else:
            depth += (c in _OPEN) - (c in _CLOSE)
            if depth == 0:
                return i
    raise ScriptError(f"'{text[at]}' is never closed", text, at)


def _keyed(files: list[dict[str, Any]], verb: str) -> list[dict[str, Any]]:
    """One trailing 'on' serves all files; later parts without a file are more keys."""
    own = [f for f in files if f["on"] is not None]
    merged: list[dict[str, Any]] = []
    for f in files:
        if merged and merged[-1]["on"] is not None and f["on"] is None and f["sub"] is None and "." not in f["file"]:
            merged[-1]["on"].append(f["file"])
        else:
            merged.append(f)
    own = [f for f in merged if f["on"] is not None]
    if len(own) == 1 and own[0] is merged[-1]:
        for f in merged:
            f["on"] = own[0]["on"]
    elif own and len(own) != len(merged):
        raise ScriptError(f"{verb}: give one 'on' at the end, or one for each file")
    return merged


def _join(rest, fragments, depth):
    kinds = {"-l": "left", "--left": "left", "-r": "right", "--right": "right", "-F": "full", "--full": "full", "--inner": "inner", "-i": "inner"}
    found, rest = _flags(rest, {**{k: v for k, v in kinds.items()}, "-L": "left_suffix=", "-R": "right_suffix="})
    how = [k for k in ("left", "right", "full", "inner") if found.pop(k, False)]
    if len(how) > 1:
        raise ScriptError("join takes one of --inner, --left, --right and --full")
    files = _keyed(_files(rest, fragments, depth), "join")
    if not files or any(f["on"] is None for f in files):
        raise ScriptError("join takes FILE on KEYS")
    for f in files:
        for k, v in found.items():
            f.setdefault(k, v)
    return {"how": how[0] if how else "inner", "files": files}


def _from(rest, fragments, depth):
    files = _keyed(_files(rest, fragments, depth), "from")
    if not files:
        raise ScriptError("from needs a file")
    if len(files) > 1 and any(f["on"] is None for f in files):
        raise ScriptError("from with several files needs 'on KEYS'")
    return {"files": files}


def _fmt(rest, fragments, depth):
    found, left = _flags(rest, {"-s": "stripes", "--stripes": "stripes", "-f": "full", "--full": "full", "-p": "precision=", "--precision": "precision=", "-h": "human", "--human": "human"})
    if left.strip():
        raise ScriptError(f"fmt takes no '{left.strip()}'")
    if "precision" in found:
        found["precision"] = _number(found["precision"], "fmt -p")
        if "full" in found or not 0 <= found["precision"] <= 255:
            raise ScriptError("fmt -p takes 0 to 255, and not with -f")
    return found


def _color(rest, fragments, depth):
    m = re.match(r"\s*-g\s+(.*)", rest, re.S)
    if m:
        return {"gradient": names(m[1])}
    cell = re.match(r"\s*-c\s*(`[^`]*`|\S+)\s+(\S+)\s+(.*)", rest, re.S)
    if cell:
        return {"column": cell[1].strip("`"), "spec": cell[2], "expr": Parser(cell[3]).whole()}
    row = re.match(r"\s*(\S+)\s+(.*)", rest, re.S)
    if not row:
        raise ScriptError("color takes SPEC EXPR")
    return {"spec": row[1], "expr": Parser(row[2]).whole()}


CHARTS = {"hist": "hist", "histogram": "hist", "bar": "bar", "spark": "spark", "sparkline": "spark", "scatter": "scatter", "line": "line", "heat": "heatmap", "heatmap": "heatmap"}
_GRAPH_FLAGS = {
    "-W": "width=", "--width": "width=", "-H": "height=", "--height": "height=", "-s": "scale=", "--scale": "scale=",
    "-A": "ascii", "--ascii": "ascii", "-x": "xrange=", "--xrange": "xrange=", "-y": "yrange=", "--yrange": "yrange=",
    "-l": "log", "--log": "log", "--xlabel": "xlabel=", "--ylabel": "ylabel=", "-b": "bins=", "--bins": "bins=",
    "-t": "title=", "--title": "title=", "-r": "ramp=", "--ramp": "ramp=", "-c": "color_by=", "--color-by": "color_by=",
    "-D": "data", "--data": "data", "-S": "svg", "--svg": "svg",
}


def _graph(rest, fragments, depth):
    found, words = {}, []
    while rest.strip():
        flags, rest = _flags(rest, _GRAPH_FLAGS)
        found |= flags
        m = re.match(r"\s*,?\s*(`[^`]*`|[^\s,]+)", rest)
        if not m:
            break
        if m[1].startswith("-"):
            raise ScriptError(f"graph has no flag '{m[1]}'{suggestion(m[1], list(_GRAPH_FLAGS))}")
        words.append(m[1].strip("`"))
        rest = rest[m.end() :]
    kind = CHARTS.get(words[0]) if words else None
    words = words[1:] if kind else words
    kind = kind or ("hist" if len(words) == 1 else "line")
    least, most = {"hist": (1, 1), "spark": (1, 1), "heatmap": (2, 2)}.get(kind, (2, None))
    if len(words) < least or (most and len(words) > most):
        raise ScriptError(f"graph {kind} takes {least}{'' if most else ' or more'} column(s)")
    for k in ("bins", "width", "height"):
        if k in found:
            found[k] = _number(found[k], f"graph --{k}")
    for k in ("xrange", "yrange"):
        if k in found:
            try:
                lo, hi = (float(x) for x in found[k].split(":"))
            except ValueError:
                raise ScriptError(f"a range is LO:HI, not '{found[k]}'") from None
            found[k] = (lo, hi)
    return {"kind": kind, "columns": words, **found}


PARSERS = {
    "cols": _cols, "select": _select, "sort": _sort, "head": _head, "tail": _tail, "stats": _columns, "uniq": _columns,
    "color": _color, "rename": _rename, "fmt": _fmt, "from": _from, "join": _join, "add": _add, "agg": _agg, "graph": _graph,
}


def uses(node: Node, *functions: str) -> bool:
    from .expr import walk

    return any(n.kind == "func" and n.value in functions for n in walk(node))
