"""A formula language compiled to columns: f(x) = x ^ 2; g(a, b) = f(a) - b / k; k = 3.2

Functions of a list may use each other in any order; ^ binds tighter than unary minus, that tighter than * / %, and those tighter than + -.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.functions import numeric

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(.))")
CONSTANTS = {"e": math.e, "pi": math.pi}
BUILT_IN: dict[str, Callable[..., Column]] = {
    **{n: getattr(F, n) for n in ("abs", "acos", "acosh", "asin", "asinh", "atan", "atanh", "ceil", "cos", "cosh", "floor", "sin", "sinh", "sqrt", "tan", "tanh")},
    "log": F.log, "erf": numeric.erf, "gamma": numeric.gamma, "lgamma": numeric.log_gamma, "sign": F.signum, "round": F.round,
    "max": lambda *a: F.greatest(*a), "min": lambda *a: F.least(*a), "ifzero": lambda a, b, c: F.when(a == 0, b).otherwise(c),
}


class FormulaError(ValueError):
    pass


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


def _parse(tokens: list[str]):
    """A nested tuple: ("num", x), ("call", name, args) or (operator, a[, b])."""
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take(want=None):
        nonlocal at
        t = peek()
        if t is None or want is not None and t != want:
            raise FormulaError(f"expected {want or 'more'} but found {t}")
        at += 1
        return t

    def level(ops, below):
        def parse():
            left = below()
            while peek() in ops:
                left = (take(), left, below())
            return left

        return parse

    def atom():
        t = take()
        if t == "(":
            inner = sums()
            take(")")
            return inner
        if re.match(r"[\d.]", t):
            return ("num", float(t))
        if re.match(r"[A-Za-z_]", t):
            args = []
            if peek() == "(":
                take()
                while peek() != ")":
                    args.append(sums())
                    if peek() == ",":
                        take()
                take(")")
            return ("call", t, args)
        raise FormulaError(f"unexpected {t}")

    def power():
        base = atom()
        return ("^", base, (take() and unary())) if peek() == "^" else base

    def unary():
        return ("neg", (take() and unary())) if peek() == "-" else power()

    products = level({"*", "/", "%"}, unary)
    sums = level({"+", "-"}, products)
    out = sums()
    if at != len(tokens):
        raise FormulaError(f"unexpected {peek()}")
    return out


class Formulas:
    """The functions of a semicolon-parted list. call(name, columns...) is a column."""

    def __init__(self, text: str):
        self.defined = {}
        for part in filter(str.strip, text.split(";")):
            head, eq, body = part.partition("=")
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?\s*", head)
            if not eq or not m:
                raise FormulaError(f"not a definition: {part.strip()}")
            names = [x.strip() for x in (m[2] or "").split(",") if x.strip()]
            self.defined[m[1]] = (names, _parse(_tokens(body)))

    def call(self, name: str, *args, depth: int = 0) -> Column:
        if name not in self.defined:
            raise FormulaError(f"no function {name}")
        names, body = self.defined[name]
        if len(names) != len(args):
            raise FormulaError(f"{name} takes {len(names)} arguments")
        if depth > 50:
            raise FormulaError(f"{name} calls itself without end")
        bound = {n: a if isinstance(a, Column) else F.lit(float(a)) for n, a in zip(names, args, strict=True)}
        return self._column(body, bound, depth)

    def _column(self, node, bound, depth) -> Column:
        kind = node[0]
        if kind == "num":
            return F.lit(node[1])
        if kind == "call":
            name, args = node[1], [self._column(x, bound, depth) for x in node[2]]
            if name in bound and not args:
                return bound[name]
            if name in self.defined:
                return self.call(name, *args, depth=depth + 1)
            if name in CONSTANTS and not args:
                return F.lit(CONSTANTS[name])
            if name in BUILT_IN:
                return BUILT_IN[name](*args)
            raise FormulaError(f"no function or variable {name}")
        a = self._column(node[1], bound, depth)
        if kind == "neg":
            return -a
        b = self._column(node[2], bound, depth)
        return {"+": a.__add__, "-": a.__sub__, "*": a.__mul__, "/": lambda x: F.try_divide(a, x), "%": lambda x: F.try_mod(a, x), "^": lambda x: F.pow(a, x)}[kind](b)
