"""Units of columns: parsing, algebra, compatibility and conversion. All of it runs on the driver, before any job."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

# Symbol, size in the base unit, base unit.
KNOWN = {
    "m": (1.0, "m"), "km": (1000.0, "m"), "cm": (0.01, "m"), "mm": (0.001, "m"), "mi": (1609.344, "m"), "ft": (0.3048, "m"), "in": (0.0254, "m"),
    "s": (1.0, "s"), "ms": (0.001, "s"), "us": (1e-6, "s"), "ns": (1e-9, "s"), "min": (60.0, "s"), "h": (3600.0, "s"), "d": (86400.0, "s"),
    "kg": (1.0, "kg"), "g": (0.001, "kg"), "mg": (1e-6, "kg"), "t": (1000.0, "kg"), "lb": (0.45359237, "kg"), "oz": (0.028349523125, "kg"),
    "B": (1.0, "B"), "KB": (1024.0, "B"), "MB": (1048576.0, "B"), "GB": (1073741824.0, "B"), "TB": (1099511627776.0, "B"),
}


class UnitError(ValueError):
    """A unit that cannot be read, or units that do not go together."""


def _power(x: float, n: int) -> float:
    """By repeated squaring, as compiled code does it."""
    out, base, left = 1.0, x, abs(n)
    while left:
        if left & 1:
            out *= base
        base *= base
        left >>= 1
    return 1.0 / out if n < 0 else out


@dataclass(frozen=True)
class Unit:
    """A scale, exponents of base dimensions, and the spelling to show."""

    scale: float = 1.0
    dims: tuple[tuple[str, int], ...] = ()
    label: str = field(default="", compare=False)

    @staticmethod
    def parse(text: str | None) -> Unit:
        """``kg*m/s^2``: everything after the first slash is inverted. Blank, ``1`` and ``-`` have no dimension; a symbol that
        is not known is a dimension of its own."""
        spelled = (text or "").strip()
        if spelled in ("", "1", "-"):
            return Unit()
        above, _, below = spelled.partition("/")
        factors = [(f.strip(), sign) for part, sign in ((above, 1), (below, -1)) for f in part.replace("·", "*").split("*") if f.strip()]
        return reduce(lambda u, f: u * Unit._factor(f[0], f[1], spelled), factors, Unit())._named(spelled)

    @staticmethod
    def _factor(factor: str, sign: int, whole: str) -> Unit:
        symbol, caret, exponent = (x.strip() for x in factor.partition("^"))
        digits = exponent[1:] if exponent[:1] in "+-" else exponent
        if caret and not (digits.isascii() and digits.isdigit()):
            raise UnitError(f"'{exponent}' is not an exponent in unit '{whole}'")
        if not symbol:
            raise UnitError(f"unit '{whole}' has an empty factor")
        if not all(c.isalnum() or c == "_" for c in symbol):
            raise UnitError(f"'{symbol}' is not a valid unit symbol")
        n = sign * (int(exponent) if caret else 1)
        size, base = KNOWN.get(symbol, (1.0, symbol))
        return Unit(_power(size, n), ((base, n),) if n else (), symbol)

    def _named(self, label: str) -> Unit:
        return Unit(self.scale, self.dims, label)

    def _joined(self, other: Unit, sign: int) -> tuple[tuple[str, int], ...]:
        dims = dict(self.dims)
        for name, n in other.dims:
            dims[name] = dims.get(name, 0) + sign * n
        return tuple(sorted((k, n) for k, n in dims.items() if n))

    def __mul__(self, other: Unit) -> Unit:
        label = "*".join(x for x in (self.label, other.label) if x)
        return Unit(self.scale * other.scale, self._joined(other, 1), label)

    def __truediv__(self, other: Unit) -> Unit:
        label = f"{self.label or '1'}/{other.label}" if other.label else self.label
        return Unit(self.scale / other.scale, self._joined(other, -1), label)

    def __pow__(self, n: int) -> Unit:
        dims = tuple((k, e * n) for k, e in self.dims if e * n)
        return Unit(_power(self.scale, n), dims, f"{self.label}^{n}" if self.label else "")

    def compatible(self, other: Unit) -> bool:
        return self.dims == other.dims

    def factor_to(self, other: Unit) -> float | None:
        """What a number in this unit is multiplied by to be in ``other``; None if they measure different things."""
        return self.scale / other.scale if self.compatible(other) else None

    def dimensions(self) -> str:
        spell = lambda pairs: "*".join(k if n == 1 else f"{k}^{n}" for k, n in pairs)
        above, below = spell([d for d in self.dims if d[1] > 0]), spell([(k, -n) for k, n in self.dims if n < 0])
        if not above and not below:
            return "dimensionless"
        return f"{above or '1'}/{below}" if below else above

    def describe(self) -> str:
        """What was written, with the base dimensions in brackets where they differ."""
        base = self.dimensions()
        return base if self.label.strip() in ("", base) else f"{self.label.strip()} [{base}]"
