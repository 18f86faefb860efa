"""Expressions of columns, as text, by precedence climbing from tokens to a Column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s*(`[^`]+`|[^\W\d]\w*|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|'[^']*'|"[^"]*"|\*\*|//|<=|>=|==|!=|[-+*/()<>&|~%,])""")
#: Names of functions of one number.
FUNCTIONS = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1, "log": F.log, "log10": F.log10, "log1p": F.log1p, "floor": F.floor, "ceil": F.ceil,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
}
#: Operators between two values from the loosest on; those of one line bind alike, to the left. `**` binds tightest, to the right.
LEVELS = [["|", "or"], ["&", "and"], ["<", "<=", ">", ">=", "==", "!="], ["+", "-"], ["*", "/", "//", "%"]]
COMPARE = 2


def _floor_divide(a: Column, b: Column) -> Column:
    return F.floor(F.try_divide(a, b))


#: Dividing by zero gives null, and the rest of a division has the sign of the divisor.
BINARY = {
    "|": lambda a, b: a | b, "or": lambda a, b: a | b, "&": lambda a, b: a & b, "and": lambda a, b: a & b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b), "//": _floor_divide, "%": lambda a, b: a - b * _floor_divide(a, b),
}


class _Reader:
    def __init__(self, text: str, columns: list[str]):
        self.columns, self.tokens, self.at = set(columns), [], 0
        end = len(text.rstrip())
        at = 0
        while at < end:
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not understood at {text[at:]!r}")
            self.tokens.append(m[1])
            at = m.end()

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, wanted: str | None = None) -> str:
        token = self.peek()
        if token is None or (wanted and token != wanted):
            raise ValueError(f"expected {wanted or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def level(self, k: int) -> Column:
        if k == len(LEVELS):
            return self.unary()
        if k == COMPARE and self.peek() == "not":
            self.take()
            return ~self.level(k)
        parts, between = [self.level(k + 1)], []
        while self.peek() in LEVELS[k]:
            between.append(self.take())
            parts.append(self.level(k + 1))
        if k == COMPARE and between:
            # a < b < c is a < b and b < c.
            return reduce(lambda a, b: a & b, [BINARY[o](x, y) for o, x, y in zip(between, parts, parts[1:], strict=False)])
        out = parts[0]
        for o, y in zip(between, parts[1:], strict=True):
            out = BINARY[o](out, y)
        return out

    def unary(self) -> Column:
        token = self.peek()
        if token in ("-", "+", "~"):
            self.take()
            value = self.unary()
            return -value if token == "-" else ~value if token == "~" else value
        base = self.atom()
        if self.peek() == "**":
            self.take()
            # The exponent takes its own signs and powers: 2 ** -3 ** 2 is 2 ** (-(3 ** 2)).
            return F.pow(base, self.unary())
        return base

    def atom(self) -> Column:
        token = self.take()
        if token == "(":
            inner = self.level(0)
            self.take(")")
            return inner
        if token[0] in "'\"":
            return F.lit(token[1:-1])
        if token[0].isdigit() or token[0] == ".":
            return F.lit(int(token)) if token.isdigit() else F.lit(float(token))
        name = token.strip("`")
        if name in self.columns:
            return F.col(f"`{name}`")
        if token in ("True", "False"):
            return F.lit(token == "True")
        if token in FUNCTIONS and self.peek() == "(":
            self.take()
            inner = self.level(0)
            self.take(")")
            return FUNCTIONS[token](inner)
        if re.match(r"[^\W\d]|`", token):
            raise ValueError(f"unknown column: {name}")
        raise ValueError(f"not expected: {token}")


def arithmetic(expression: str, columns: list[str]) -> Column:
    """A Column of an expression of columns (in backticks where they are no names), numbers, strings, + - * / // % **, comparisons
    (also chained), & | ~ and or not, and FUNCTIONS; anything else is refused with a ValueError.

    & and | bind as loosely as and and or. `**` goes to the right and binds tighter than a sign before it. Dividing by zero, with /, //
    or %, gives null."""
    reader = _Reader(expression, columns)
    out = reader.level(0)
    if reader.peek() is not None:
        raise ValueError(f"not expected: {reader.peek()}")
    return out
