"""C integer formulas: evaluation with C's truncating division, short circuits and a range cap."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

TOKEN = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+)[uUlL]*|([A-Za-z_]\w*)|(<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^~!<>?:()]))")
LEVELS = (("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", "<=", ">", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
LIMIT = 0x7FFFFFFF


class Unknown(Exception):
    """The formula has no value."""


def _number(t: str) -> int:
    if t[:2] in ("0x", "0X"):
        return int(t, 16)
    if t[:2] in ("0b", "0B"):
        return int(t[2:], 2)
    return int(t, 8) if len(t) > 1 and t[0] == "0" else int(t)


def _apply(op: str, a: int, b: int) -> int:
    if op in ("/", "%"):
        if not b:
            raise Unknown
        q = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
        return q if op == "/" else a - q * b
    if op in ("<<", ">>"):
        if not 0 <= b < 32:
            raise Unknown
        return a << b if op == "<<" else a >> b
    if op in ("==", "!=", "<", "<=", ">", ">="):
        return int({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
    return {"+": a + b, "-": a - b, "*": a * b, "&": a & b, "|": a | b, "^": a ^ b}[op]


def evaluate(text: str | None, names: dict[str, int] | None = None) -> int | None:
    """The formula's value; null for no formula, unknown names, division by zero or results beyond 32 bits."""
    if text is None:
        return None
    tokens: list[tuple[str, str]] = []
    at = 0
    stripped = text.rstrip()
    while at < len(stripped):
        m = TOKEN.match(stripped, at)
        if not m:
            return None
        tokens.append(("n", m[1]) if m[1] else ("i", m[2]) if m[2] else ("p", m[3]))
        at = m.end()
    tokens.append(("p", ""))
    pos = 0

    def peek() -> str:
        return tokens[pos][1] if tokens[pos][0] == "p" else "\x00"

    def unary(live: bool) -> int:
        nonlocal pos
        kind, t = tokens[pos]
        pos += 1
        if kind == "n":
            try:
                return _number(t)
            except ValueError:
                raise Unknown from None
        if kind == "i":
            if t not in (names or {}):
                if live:
                    raise Unknown
                return 0
            return names[t]
        if t == "(":
            v = ternary(live)
            if peek() != ")":
                raise Unknown
            pos += 1
            return v
        if t in ("-", "+", "~", "!"):
            v = unary(live)
            return {"-": -v, "+": v, "~": ~v, "!": int(not v)}[t]
        raise Unknown

    def binary(level: int, live: bool) -> int:
        nonlocal pos
        if level == len(LEVELS):
            return unary(live)
        v = binary(level + 1, live)
        while peek() in LEVELS[level] and peek():
            op = peek()
            pos += 1
            if op == "&&":
                v = int(bool(binary(level + 1, live and bool(v))) and bool(v))
            elif op == "||":
                v = int(bool(binary(level + 1, live and not v)) or bool(v))
            else:
                w = binary(level + 1, live)
                v = _apply(op, v, w) if live else 0
        return v

    def ternary(live: bool) -> int:
        nonlocal pos
        c = binary(0, live)
        if peek() != "?":
            return c
        pos += 1
        a = ternary(live and bool(c))
        if peek() != ":":
            raise Unknown
        pos += 1
        b = ternary(live and not c)
        return a if c else b

    try:
        v = ternary(True)
    except (Unknown, RecursionError):
        return None
    return v if pos == len(tokens) - 1 and -LIMIT <= v <= LIMIT else None


@F.pandas_udf(LongType())
def _formula(texts: pd.Series) -> pd.Series:
    return texts.map(evaluate).astype("Int64")


def c_formula(text: Column) -> Column:
    """The value of a closed C integer formula."""
    return _formula(text)


@F.pandas_udf(StringType())
def _bare(texts: pd.Series) -> pd.Series:
    return texts.map(strip_parens)


def strip_parens(text: str | None) -> str | None:
    """A text without balanced parentheses around all of it."""
    if text is None:
        return None
    text = text.strip()
    while text[:1] == "(" and text[-1:] == ")":
        depth = 0
        for i, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if not depth and i < len(text) - 1:
                return text
        if depth:
            return text
        text = text[1:-1].strip()
    return text


def without_parens(text: Column) -> Column:
    """:func:`strip_parens` of a column."""
    return _bare(text)
