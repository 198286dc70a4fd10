"""Expressions of the pipe language: tokens, syntax tree and a precedence-climbing parser."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .errors import ScriptError, suggestion

#: Functions with their least and most number of arguments (None: any).
FUNCTIONS: dict[str, tuple[int, int | None]] = {
    **dict.fromkeys(
        ["round", "floor", "ceil", "int", "abs", "sqrt", "exp", "log", "log10", "log2", "sign"], (1, 1)
    ),
    **dict.fromkeys(["len", "upper", "lower", "trim", "num", "str", "prev"], (1, 1)),
    **dict.fromkeys(["min", "max", "coalesce"], (1, None)),
    "pow": (2, 2),
    "rownum": (0, 0),
}

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w.]))
    | (?P<str>'[^']*'|"[^"]*")
    | (?P<tick>`[^`]*`)
    | (?P<name>[^\W\d][\w.]*)
    | (?P<op>\+\+|==|!=|<=|>=|=~|!~|\^=|\*=|\$=|&&|\|\||[-+*/%<>=!?:(),])
    )""",
    re.X,
)


@dataclass(frozen=True)
class Node:
    kind: str  # num str col func neg bin cmp match and or not if
    at: int
    value: object = None
    args: tuple[Node, ...] = ()


Token = tuple[str, str, int]
_COMPARE = {"==", "=", "!=", "<", ">", "<=", ">="}
_MATCH = {"=~", "!~", "^=", "*=", "$="}
_BOOLEAN = {"cmp", "match", "and", "or", "not"}


def tokens(text: str, base: int = 0) -> list[Token]:
    out, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            bad = at + len(text[at:]) - len(text[at:].lstrip())
            raise ScriptError(f"unexpected '{text[bad]}' in expression", text, bad)
        kind = m.lastgroup or ""
        out.append((kind, m[kind], base + m.start(kind)))
        at = m.end()
    return out


class Parser:
    """Precedence, loosest first: ?:  ||  &&  !  comparison  ++  + -  * / %  unary  atom."""

    def __init__(self, text: str, base: int = 0, fragments: frozenset[str] = frozenset()) -> None:
        self.text, self.items, self.i, self.fragments = text, tokens(text, base), 0, fragments

    def fail(self, message: str) -> ScriptError:
        at = self.items[self.i][2] if self.i < len(self.items) else len(self.text)
        return ScriptError(message, self.text, min(at, len(self.text)))

    def peek(self) -> str:
        return self.items[self.i][1] if self.i < len(self.items) and self.items[self.i][0] == "op" else ""

    def take(self, *ops: str) -> str:
        if self.peek() in ops:
            self.i += 1
            return self.items[self.i - 1][1]
        return ""

    def need(self, op: str) -> None:
        if not self.take(op):
            raise self.fail(f"expected '{op}'")

    def whole(self) -> Node:
        node = self.ternary()
        if self.i < len(self.items):
            raise self.fail(f"unexpected '{self.items[self.i][1]}'")
        return node

    def condition(self, node: Node) -> Node:
        if node.kind not in _BOOLEAN and not (node.kind == "if" and all(a.kind in _BOOLEAN for a in node.args[1:])):
            raise ScriptError("a condition is needed here (a comparison, or &&, ||, ! of them)", self.text, node.at)
        return node

    def ternary(self) -> Node:
        test = self.either()
        if not self.take("?"):
            return test
        yes = self.ternary()
        self.need(":")
        return Node("if", test.at, None, (self.condition(test), yes, self.ternary()))

    def either(self) -> Node:
        node = self.both()
        while self.take("||"):
            node = Node("or", node.at, None, (self.condition(node), self.condition(self.both())))
        return node

    def both(self) -> Node:
        node = self.negation()
        while self.take("&&"):
            node = Node("and", node.at, None, (self.condition(node), self.condition(self.negation())))
        return node

    def negation(self) -> Node:
        at = self.items[self.i][2] if self.i < len(self.items) else 0
        if self.take("!"):
            return Node("not", at, None, (self.condition(self.negation()),))
        return self.comparison()

    def comparison(self) -> Node:
        left = self.concat()
        op = self.take(*_COMPARE, *_MATCH)
        if not op:
            return left
        right = self.concat()
        if self.peek() in _COMPARE | _MATCH:
            raise self.fail("comparisons do not chain; use && between them")
        if op in _MATCH:
            if left.kind != "col" or right.kind != "str":
                raise ScriptError(f"'{op}' takes a column on its left and a quoted text on its right", self.text, left.at)
            return Node("match", left.at, op, (left, right))
        return Node("cmp", left.at, "==" if op == "=" else op, (left, right))

    def concat(self) -> Node:
        node = self.sum()
        while self.take("++"):
            node = Node("bin", node.at, "++", (node, self.sum()))
        return node

    def sum(self) -> Node:
        node = self.product()
        while op := self.take("+", "-"):
            node = Node("bin", node.at, op, (node, self.product()))
        return node

    def product(self) -> Node:
        node = self.unary()
        while op := self.take("*", "/", "%"):
            node = Node("bin", node.at, op, (node, self.unary()))
        return node

    def unary(self) -> Node:
        at = self.items[self.i][2] if self.i < len(self.items) else 0
        if self.take("-"):
            inner = self.unary()
            return Node("num", at, -inner.value) if inner.kind == "num" else Node("neg", at, None, (inner,))
        if self.take("+"):
            return self.unary()
        return self.atom()

    def atom(self) -> Node:
        if self.take("("):
            node = self.ternary()
            self.need(")")
            # a parenthesised condition is a plain value to what stands around it
            return node
        if self.i >= len(self.items):
            raise self.fail("the expression ends too early")
        kind, text, at = self.items[self.i]
        if kind == "op":
            raise self.fail(f"'{text}' cannot start a value")
        self.i += 1
        if kind == "num":
            return Node("num", at, float(text))
        if kind == "str":
            return Node("str", at, text[1:-1])
        if kind == "tick":
            return Node("col", at, text[1:-1])
        if self.take("("):
            args = []
            if not self.take(")"):
                args.append(self.ternary())
                while self.take(","):
                    args.append(self.ternary())
                self.need(")")
            return self.call(text, tuple(args), at)
        if text.lower() in ("inf", "infinity", "nan"):
            return Node("word", at, text)
        return Node("col", at, text)

    def call(self, name: str, args: tuple[Node, ...], at: int) -> Node:
        if name not in FUNCTIONS:
            hint = "; a fragment is a whole stage" if name in self.fragments else suggestion(name, list(FUNCTIONS))
            raise ScriptError(f"unknown function '{name}'{hint}", self.text, at)
        least, most = FUNCTIONS[name]
        if len(args) < least or (most is not None and len(args) > most):
            raise ScriptError(f"'{name}' takes {least if most == least else f'at least {least}'} argument(s)", self.text, at)
        if name == "prev" and args[0].kind != "col":
            raise ScriptError("prev() takes one column", self.text, at)
        return Node("func", at, name, args)


def walk(node: Node):
    yield node
    for a in node.args:
        yield from walk(a)
