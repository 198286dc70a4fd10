"""Drawings of charts, from the few rows that Spark has reduced: terminal and SVG; and colours."""

from __future__ import annotations

import html
import math
from collections.abc import Iterator, Mapping
from typing import TYPE_CHECKING, Any, NamedTuple

from pyspark.sql import functions as F

from ..engine import painted
from ..functions.values import format_number
from ..operators.charts import MOST_BARS
from ..plans.errors import ScriptError

if TYPE_CHECKING:
    from ..engine import Output

_BLOCKS = " ▁▂▃▄▅▆▇█"
_PARTS = "▏▎▍▌▋▊▉█"
SVG_SIZE = (720, 440)
# ANSI numbers and hex forms of the nine base colours.
COLORS = {"black": (30, "#000000"), "red": (31, "#cc0000"), "green": (32, "#00aa00"), "yellow": (33, "#c4a000"), "blue": (34, "#3465a4"), "magenta": (35, "#75507b"), "cyan": (36, "#06989a"), "white": (37, "#d3d7cf"), "gray": (90, "#888888")}
ATTRIBUTES = {"bold": 1, "dim": 2, "underline": 4}


def _rows(out: Output) -> list[list[Any]]:
    """The rows of a chart that is a reduction; of bars as many as are drawn."""
    frame = out.frame(ordered=True)
    return [list(r) for r in (frame.limit(MOST_BARS) if out.chart["kind"] == "bar" else frame).collect()]


class Points(NamedTuple):
    """Points brought to a grid of cells in Spark: (series, column, row, colour value), and the bounds."""

    cells: list[tuple[int, int, int, float | None]]
    x: tuple[float, float]
    y: tuple[float, float]
    tint: tuple[float, float] | None


def _points(out: Output, across: int, down: int) -> Points | None:
    """One point for each cell of the grid that has some, at most series x across x down of them."""
    rel, args = out.relation, out.chart
    x, tint = F.col(args["place"]), F.col(args["tint"])
    series = F.array(*(F.struct(F.lit(i).alias("s"), x.alias("x"), F.col(f.physical).alias("y"), tint.alias("t")) for i, f in enumerate(rel.fields[1:])))
    df = rel.df.select(F.inline(series)).filter("y IS NOT NULL")
    found = df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.min("t"), F.max("t")).first()
    if found[0] is None:
        return None
    x0, x1, y0, y1, t0, t1 = found

    def cell(name: str, lo: float, hi: float, n: int) -> Any:
        return F.round((F.col(name) / 2 - lo / 2) / ((hi / 2 - lo / 2) or 1.0) * (n - 1)).cast("int")

    made = df.groupBy("s", cell("x", x0, x1, across).alias("i"), cell("y", y0, y1, down).alias("j")).agg(F.avg("t").alias("t"))
    cells = sorted((r.s, r.i, r.j, r.t) for r in made.collect())
    return Points(cells, (x0, x1), (y0, y1), None if t0 is None else (t0, t1))


def _ramp(args: dict[str, Any], default: str) -> tuple[str, str]:
    ends = (args.get("ramp") or default).split(":")
    if len(ends) != 2 or any(e not in COLORS for e in ends):
        raise ScriptError(f"a ramp is two colours, LOW:HIGH, of {', '.join(COLORS)}")
    return ends[0], ends[1]


def _mixed(value: float, lo: float, hi: float, a: str, b: str) -> tuple[int, int, int]:
    part = 0.0 if hi == lo else max(0.0, min(1.0, (value - lo) / (hi - lo)))
    ends = [[int(COLORS[c][1][i : i + 2], 16) for i in (1, 3, 5)] for c in (a, b)]
    r, g, bl = (round(x + (y - x) * part) for x, y in zip(*ends, strict=True))
    return r, g, bl


def _number(v: Any) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _bar(part: float, width: int, ascii_only: bool) -> str:
    eighths = round(max(0.0, min(1.0, part)) * width * 8)
    if ascii_only:
        return "#" * round(eighths / 8)
    return "█" * (eighths // 8) + (_PARTS[eighths % 8 - 1] if eighths % 8 else "")


def ticks(lo: float, hi: float, most: int = 6) -> list[float]:
    """Round axis marks in steps of 1, 2 or 5 times a power of ten."""
    span = hi - lo or 1.0
    raw = span / max(1, most - 1)
    power = 10.0 ** math.floor(math.log10(raw))
    step = next(s * power for s in (1, 2, 5, 10) if s * power >= raw * (1 - 1e-9))
    first = math.ceil(lo / step)
    return [i * step for i in range(first, math.floor(hi / step) + 1)]


def terminal(out: Output, depth: int = 0) -> Iterator[str]:
    """The chart as lines of text, then what it leaves out; ``depth`` 24 or 8: coloured with so many bits."""
    args, header = out.chart, out.header
    scale = float(args.get("scale") or 1)
    width, height, plain = args.get("width") or round(80 * scale), args.get("height") or round(20 * scale), bool(args.get("ascii"))
    if args.get("title"):
        yield args["title"].center(width).rstrip()
    kind = args["kind"]
    if kind in ("scatter", "line"):
        yield from _plot(out, width, height, plain, depth)
    else:
        rows = _rows(out)
        if kind in ("hist", "bar"):
            if kind == "hist":
                items = [(f"{format_number(r[0])} – {format_number(r[1])}", float(r[2])) for r in rows]
            else:
                items = [(str(r[0]) if i == 0 else header[i + 1], v) for r in rows for i, v in enumerate(map(_number, r[1:])) if v is not None]
            pad = max((len(label) for label, _ in items), default=0)
            top = max((abs(v) for _, v in items), default=0) or 1.0
            room = max(4, width - pad - 14)
            for label, v in items:
                yield f"{label:>{pad}} {_bar(abs(v) / top, room, plain)} {format_number(v)}"
        elif kind == "spark":
            values = [float(r[1]) for r in rows]
            lo, hi = min(values, default=0), max(values, default=0)
            yield "".join(_BLOCKS[1 + round((v - lo) / (hi - lo or 1) * 7)] for v in values)
            yield f"{format_number(lo)} .. {format_number(hi)}"
        else:
            yield from _grid(rows, plain, _ramp(args, "blue:red") if args.get("ramp") else None, depth)
    left_out = out.notes()
    if left_out:
        yield "; ".join(left_out)


def _grid(rows: list[list[Any]], plain: bool, ramp: tuple[str, str] | None, depth: int) -> Iterator[str]:
    xs, ys = sorted({r[0] for r in rows}), sorted({r[1] for r in rows}, reverse=True)
    top, cells = max((r[2] for r in rows), default=1), {(r[0], r[1]): r[2] for r in rows}
    marks = " .:-=+*#%@" if plain else " ░▒▓█"

    def mark(n: int) -> str:
        if n and ramp and depth:
            return f"\x1b[{foreground(_mixed(n, 0, top, *ramp), depth)}m█\x1b[0m"
        return marks[math.ceil(n / top * (len(marks) - 1))]

    for y in ys:
        yield "".join(mark(cells.get((x, y), 0)) for x in xs)


def _plot(out: Output, width: int, height: int, plain: bool, depth: int) -> Iterator[str]:
    """Points on a braille grid of 2 by 4 dots for each character."""
    wide, tall = (1, 1) if plain else (2, 4)
    points = _points(out, wide * width, tall * height)
    if points is None:
        return
    bit = {(0, 0): 1, (0, 1): 2, (0, 2): 4, (1, 0): 8, (1, 1): 16, (1, 2): 32, (0, 3): 64, (1, 3): 128}
    dots: dict[tuple[int, int], int] = {}
    tints: dict[tuple[int, int], list[float]] = {}
    for _, i, j, t in points.cells:
        row = tall * height - 1 - j
        at = i // wide, row // tall
        dots[at] = dots.get(at, 0) | (1 if plain else bit[i % wide, row % tall])
        if t is not None:
            tints.setdefault(at, []).append(t)
    ramp = _ramp(out.chart, "blue:red") if depth and points.tint else None

    def mark(at: tuple[int, int]) -> str:
        shown = ("*" if at in dots else " ") if plain else chr(0x2800 + dots.get(at, 0))
        if ramp and at in tints:
            return f"\x1b[{foreground(_mixed(sum(tints[at]) / len(tints[at]), *points.tint, *ramp), depth)}m{shown}\x1b[0m"
        return shown

    for row in range(height):
        line = "".join(mark((c, row)) for c in range(width))
        yield line.rstrip() if plain else line
    (x0, x1), (y0, y1) = points.x, points.y
    yield f"x {format_number(x0)} .. {format_number(x1)}   y {format_number(y0)} .. {format_number(y1)}"


def svg(out: Output) -> str:
    """The chart as a standalone SVG document."""
    args, (w, h) = out.chart, SVG_SIZE
    left, right, top, bottom = 64, 20, 36, 48
    shapes = list(COLORS.values())
    body: list[str] = []
    kind, bars = args["kind"], []
    rows = [] if kind in ("scatter", "line") else _rows(out)
    if kind == "hist":
        bars = [(float(r[0]), float(r[1]), float(r[2]), 0) for r in rows]
    elif kind in ("bar", "spark"):
        bars = [(float(i), i + 1.0, v, s) for i, r in enumerate(rows) for s, v in enumerate(map(_number, r[1:])) if v is not None]
    elif kind == "heatmap":
        xs, ys = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
        most = max((r[2] for r in rows), default=1)
        cw, ch = (w - left - right) / max(1, len(xs)), (h - top - bottom) / max(1, len(ys))
        ramp = _ramp(args, "blue:red") if args.get("ramp") else None
        for x, y, n in rows:
            place = f'x="{left + xs.index(x) * cw:.1f}" y="{h - bottom - (ys.index(y) + 1) * ch:.1f}" width="{cw:.1f}" height="{ch:.1f}"'
            fill = 'fill="#{:02x}{:02x}{:02x}"'.format(*_mixed(n, 0, most, *ramp)) if ramp else f'fill="#3465a4" fill-opacity="{n / most:.3f}"'
            body.append(f"<rect {place} {fill}/>")
    elif points := _points(out, w - left - right + 1, h - top - bottom + 1):  # a cell is a pixel
        ramp = _ramp(args, "blue:red")
        for s in sorted({c[0] for c in points.cells}):
            own, color = [c for c in points.cells if c[0] == s], shapes[(s + 4) % len(shapes)][1]
            if kind == "line":
                body.append(f'<polyline fill="none" stroke="{color}" points="{" ".join(f"{left + i},{h - bottom - j}" for _, i, j, _ in own)}"/>')
                continue
            for _, i, j, t in own:
                tint = color if t is None else "#{:02x}{:02x}{:02x}".format(*_mixed(t, *points.tint, *ramp))
                body.append(f'<circle cx="{left + i}" cy="{h - bottom - j}" r="2.5" fill="{tint}"/>')
        body += _axis(*points.x, *points.y, left, right, top, bottom)
    if bars:
        lo, hi = min(b[0] for b in bars), max(b[1] for b in bars)
        most = max(abs(b[2]) for b in bars) or 1.0
        for a, b, v, s in bars:
            x, wide = left + (a - lo) / (hi - lo or 1) * (w - left - right), (b - a) / (hi - lo or 1) * (w - left - right)
            tall = abs(v) / most * (h - top - bottom)
            body.append(f'<rect x="{x:.1f}" y="{h - bottom - tall:.1f}" width="{max(1, wide - 1):.1f}" height="{tall:.1f}" fill="{shapes[(s + 4) % len(shapes)][1]}"/>')
        body += _axis(lo, hi, 0.0, most, left, right, top, bottom)
    title = html.escape(args.get("title") or " / ".join(out.header))
    labels = [f'<text x="{w / 2}" y="22" text-anchor="middle">{title}</text>']
    labels += [f'<text x="{w / 2}" y="{h - 8}" text-anchor="middle">{html.escape(args["xlabel"])}</text>'] if args.get("xlabel") else []
    left_out = out.notes()
    labels += [f'<text x="{w - 8}" y="{h - 8}" text-anchor="end" fill="#888888">{html.escape("; ".join(left_out))}</text>'] if left_out else []
    labels += [f'<text x="14" y="{h / 2}" transform="rotate(-90 14 {h / 2})" text-anchor="middle">{html.escape(args["ylabel"])}</text>'] if args.get("ylabel") else []
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}" height="{h}" viewBox="0 0 {w} {h}" font-family="sans-serif" font-size="12">{"".join(labels + body)}</svg>\n'


def _axis(x0: float, x1: float, y0: float, y1: float, left: int, right: int, top: int, bottom: int) -> list[str]:
    w, h = SVG_SIZE
    out = [f'<path d="M{left} {top}V{h - bottom}H{w - right}" fill="none" stroke="#888888"/>']
    for t in ticks(x0, x1):
        out.append(f'<text x="{left + (t - x0) / (x1 - x0 or 1) * (w - left - right):.1f}" y="{h - bottom + 16}" text-anchor="middle">{format_number(t)}</text>')
    for t in ticks(y0, y1):
        out.append(f'<text x="{left - 6}" y="{h - bottom - (t - y0) / (y1 - y0 or 1) * (h - top - bottom) + 4:.1f}" text-anchor="end">{format_number(t)}</text>')
    return out


def style(spec: str) -> tuple[dict[str, int], set[int]]:
    """A colour spec like bold+white+bg:red as ({fg, bg}, attributes)."""
    colors, attributes = {}, set()
    for part in spec.split("+"):
        name = part.removeprefix("bg:")
        if part in ATTRIBUTES:
            attributes.add(ATTRIBUTES[part])
        elif name in COLORS:
            colors["bg" if part != name else "fg"] = COLORS[name][0] + (10 if part != name else 0)
        else:
            raise ScriptError(f"unknown colour '{part}'; there are {', '.join(COLORS)}")
    return colors, attributes


def foreground(rgb: tuple[int, int, int], depth: int) -> str:
    """The code of a foreground colour in 24 bits, or the nearest of the 6 x 6 x 6 cube of 256 colours."""
    if depth == 24:
        return "38;2;" + ";".join(map(str, rgb))
    r, g, b = (min(5, max(0, round((c - 35) / 40))) for c in rgb)
    return f"38;5;{16 + 36 * r + 6 * g + b}"


def gradient(value: float, lo: float, hi: float, a: str, b: str, depth: int = 24) -> str:
    """The colour code of a value between two base colours."""
    return foreground(_mixed(value, lo, hi, a, b), depth)


def color_depth(wanted: str, terminal: bool, environment: Mapping[str, str]) -> int:
    """0, 8 or 24 bits of colour: what was asked for, else what the environment and the output allow."""
    if wanted == "never" or (wanted == "auto" and environment.get("NO_COLOR")):
        return 0
    if wanted == "auto" and not terminal and environment.get("CLICOLOR_FORCE", "0") == "0":
        return 0
    return 24 if environment.get("COLORTERM") in ("truecolor", "24bit") else 8


def _gradients(out: Output) -> list[tuple[int, float, float, str, str]]:
    """(position, low, high, colours) of each gradient; bounds and colours may stand among the columns."""
    header, found = out.header, []
    for rule in (r for r in out.colors if "gradient" in r):
        names = [n for n in rule["gradient"] if n in header]
        ends, bounds = ("green", "red"), []
        for word in (n for n in rule["gradient"] if n not in header):
            low, _, high = word.partition(":")
            if low in COLORS and high in COLORS:
                ends = low, high
            elif (value := _number(word)) is not None:
                bounds.append(value)
        for n in names:
            value = out.relation.get(n).value().optional()
            lo, hi = bounds if len(bounds) == 2 else out.relation.df.agg(F.min(value), F.max(value)).first()
            if lo is not None:
                found.append((header.index(n), lo, hi, *ends))
    return found


def colored(out: Output, depth: int = 24) -> Iterator[list[str]]:
    """Rows of cells with ANSI colours from the rules; later rules win over earlier ones."""
    rules, ramps, header = painted(out), _gradients(out), out.header
    width = len(header)
    marks = [F.coalesce(c, F.lit(False)).alias(f"m{i}") for i, (_, c) in enumerate(rules)]
    df = out.relation.df.orderBy(*out.relation.order_columns()) if out.relation.order else out.relation.df
    for row in df.select(*out._columns(as_text=True), *marks).toLocalIterator(prefetchPartitions=True):
        cells, codes = list(row[:width]), [({}, set()) for _ in range(width)]
        for (rule, _), hit in zip(rules, row[width:], strict=True):
            if not hit:
                continue
            colors, attributes = style(rule["spec"])
            only = rule.get("column")
            for i in range(width) if only is None else [header.index(only)] if only in header else []:
                codes[i][0].update(colors)
                codes[i][1].update(attributes)
        done = []
        for i, (cell, (colors, attributes)) in enumerate(zip(cells, codes, strict=True)):
            parts = [str(a) for a in sorted(attributes)] + [str(v) for v in colors.values()]
            value = _number(cell)
            parts += [gradient(value, lo, hi, a, b, depth) for at, lo, hi, a, b in ramps if at == i and value is not None]
            done.append(f"\x1b[{';'.join(parts)}m{cell}\x1b[0m" if parts else cell)
        yield done
