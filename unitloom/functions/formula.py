"""Formulas of computed columns: a grammar, a unit check on the driver, and compilation to native columns.

    sum     = product (("+" | "-") product)*
    product = signed (("*" | "/") signed)*
    signed  = "-" signed | power
    power   = atom ("^" ["-"] whole number)?
    atom    = number | name | "(" sum ")"
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitloom.functions.units import Unit, UnitError

_TOKEN = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d]\w*)|(?P<mark>[-+*/^()]))")
MAX_POWER = 64


class FormulaError(ValueError):
    """A formula that cannot be read or does not fit its columns."""


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Negative:
    of: Expr


@dataclass(frozen=True)
class Power:
    base: Expr
    exponent: int


@dataclass(frozen=True)
class Binary:
    mark: str
    left: Expr
    right: Expr


Expr = Number | Name | Negative | Power | Binary


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            found = _TOKEN.match(text, at)
            if not found:
                raise FormulaError(f"unexpected '{text[at:].lstrip()[:1]}' in formula '{text}'")
            self.tokens.append((found.lastgroup or "", found[found.lastgroup or 0]))
            at = found.end()
        self.text, self.at = text, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("", "")

    def take(self, *marks: str) -> str | None:
        kind, value = self.peek()
        if kind == "mark" and value in marks:
            self.at += 1
            return value
        return None

    def chain(self, part: Callable[[], Expr], *marks: str) -> Expr:
        out = part()
        while mark := self.take(*marks):
            out = Binary(mark, out, part())
        return out

    def sum(self) -> Expr:
        return self.chain(self.product, "+", "-")

    def product(self) -> Expr:
        return self.chain(self.signed, "*", "/")

    def signed(self) -> Expr:
        return Negative(self.signed()) if self.take("-") else self.power()

    def power(self) -> Expr:
        base = self.atom()
        if not self.take("^"):
            return base
        sign = -1 if self.take("-") else 1
        kind, value = self.peek()
        if kind != "number" or not value.isdigit():
            raise FormulaError(f"the exponent after '^' must be a whole number in formula '{self.text}'")
        self.at += 1
        if int(value) > MAX_POWER:
            raise FormulaError(f"exponents above {MAX_POWER} are not supported")
        return Power(base, sign * int(value))

    def atom(self) -> Expr:
        kind, value = self.peek()
        self.at += 1
        if kind == "number":
            return Number(float(value))
        if kind == "name":
            return Name(value)
        if value == "(":
            inner = self.sum()
            if not self.take(")"):
                raise FormulaError(f"missing ')' in formula '{self.text}'")
            return inner
        raise FormulaError(f"formula '{self.text}' ends too early" if not kind else f"unexpected '{value}' in formula '{self.text}'")


def parse(text: str) -> Expr:
    parser = _Parser(text)
    out = parser.sum()
    if parser.at < len(parser.tokens):
        raise FormulaError(f"unexpected '{parser.peek()[1]}' in formula '{text}'")
    return out


def _names(expr: Expr) -> Iterator[str]:
    match expr:
        case Name(name):
            yield name
        case Negative(of) | Power(of, _):
            yield from _names(of)
        case Binary(_, left, right):
            yield from _names(left)
            yield from _names(right)


def columns_of(expr: Expr) -> list[str]:
    """The columns a formula reads, in order of first mention."""
    return list(dict.fromkeys(_names(expr)))


def unit_of(expr: Expr, units: Mapping[str, Unit]) -> Unit:
    """The unit of a formula's value. Numbers have none; sums need one dimension and keep the left unit."""
    match expr:
        case Number():
            return Unit()
        case Name(name):
            if name not in units:
                raise FormulaError(f"there is no column '{name}'")
            return units[name]
        case Negative(of):
            return unit_of(of, units)
        case Power(base, n):
            return unit_of(base, units) ** n
        case Binary(mark, left, right):
            a, b = unit_of(left, units), unit_of(right, units)
            if mark == "*":
                return a * b
            if mark == "/":
                return a / b
            if not a.compatible(b):
                raise UnitError(f"cannot {'add' if mark == '+' else 'subtract'} {a.describe()} and {b.describe()}")
            return a


def _quotient(a: Column, b: Column) -> Column:
    """IEEE division: by zero it gives an infinity of the right sign, or NaN, instead of an error."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def _repeated(x: Column, n: int) -> Column:
    out: Column | None = None
    square, left = x, abs(n)
    while left:
        if left & 1:
            out = square if out is None else out * square
        left >>= 1
        if left:
            square = square * square
    out = F.when(x.isNotNull(), F.lit(1.0)) if out is None else out
    return _quotient(F.lit(1.0), out) if n < 0 else out


def compile_column(expr: Expr, units: Mapping[str, Unit], column: Callable[[str], Column]) -> Column:
    """The formula over doubles; null if any input is. The right side of a sum is scaled to the left side's unit."""
    match expr:
        case Number(value):
            return F.lit(value)
        case Name(name):
            return column(name).cast("double")
        case Negative(of):
            return -compile_column(of, units, column)
        case Power(base, n):
            return _repeated(compile_column(base, units, column), n)
        case Binary(mark, left, right):
            a, b = compile_column(left, units, column), compile_column(right, units, column)
            if mark == "*":
                return a * b
            if mark == "/":
                return _quotient(a, b)
            factor = unit_of(right, units).factor_to(unit_of(left, units))
            b = b if factor == 1.0 else b * F.lit(factor)
            return a + b if mark == "+" else a - b


def to_whole(x: Column) -> Column:
    """A double to a 64-bit integer: halves away from zero, NaN to 0, held within the range."""
    largest, smallest = 9223372036854775807, -9223372036854775808
    return F.when(F.isnan(x), F.lit(0).cast("long")).when(x >= float(largest), F.lit(largest)).when(x <= float(smallest), F.lit(smallest)).otherwise(F.round(x).cast("long"))
