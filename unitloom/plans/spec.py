"""What a table's columns are: name, type, unit, formula, note; and how headers spell that."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitloom.functions.formula import FormulaError, columns_of, parse, unit_of
from unitloom.functions.units import Unit, UnitError

TYPES = ("bool", "int", "float", "string")
_OF_SPARK = {"boolean": "bool", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float"}


def quoted(name: str) -> Column:
    """A column by its exact name, whatever dots or parentheses that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "string"
    unit: str | None = None
    expr: str | None = None
    doc: str | None = None

    @property
    def header(self) -> str:
        return self.name + (f" ({self.unit})" if self.unit else "") + (f" = {self.expr}" if self.expr else "")


def split_header(text: str) -> ColumnSpec:
    """``name (unit) = formula``; the unit may stand in brackets. The type is left as string."""
    left, equals, expr = text.partition("=")
    left, unit = left.strip(), None
    if found := re.fullmatch(r"(.*\S)\s*(?:\(([^()]*)\)|\[([^\[\]]*)\])", left, re.S):
        left, unit = found[1].strip(), (found[2] if found[2] is not None else found[3]).strip() or None
    return ColumnSpec(left, unit=unit, expr=expr.strip() or None if equals else None)


@dataclass(frozen=True)
class TableSpec:
    columns: tuple[ColumnSpec, ...]

    @staticmethod
    def of(columns: Iterable[ColumnSpec]) -> TableSpec:
        return TableSpec(tuple(columns))

    @staticmethod
    def from_frame(df, units: dict[str, str] | None = None, exprs: dict[str, str] | None = None) -> TableSpec:
        """Types from the frame's schema; columns of other Spark types count as strings."""
        units, exprs = units or {}, exprs or {}
        return TableSpec(tuple(ColumnSpec(n, _OF_SPARK.get(t, "string"), units.get(n), exprs.get(n)) for n, t in df.dtypes))

    def get(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name == name), None)

    def with_column(self, column: ColumnSpec) -> TableSpec:
        if self.get(column.name):
            return TableSpec(tuple(column if c.name == column.name else c for c in self.columns))
        return TableSpec((*self.columns, column))

    def edit(self, name: str, **changes) -> TableSpec:
        return TableSpec(tuple(replace(c, **changes) if c.name == name else c for c in self.columns))

    def units(self) -> dict[str, Unit]:
        return {c.name: Unit.parse(c.unit) for c in self.columns}

    def problems(self) -> list[tuple[str, str, str]]:
        """``(severity, column, message)`` of all that can be known without reading rows."""
        found, seen, units = [], set(), {}
        for c in self.columns:
            if not c.name.strip():
                found.append(("error", c.name, "a column has a blank name"))
            elif c.name in seen:
                found.append(("error", c.name, f"column name '{c.name}' is used twice"))
            seen.add(c.name)
            if c.type not in TYPES:
                found.append(("error", c.name, f"'{c.type}' is not a column type"))
            try:
                units[c.name] = Unit.parse(c.unit)
            except UnitError as e:
                found.append(("error", c.name, str(e)))
        computed = {c.name for c in self.columns if c.expr}
        done: set[str] = set()
        for c in self.columns:
            if c.expr:
                try:
                    tree = parse(c.expr)
                    missing = [n for n in columns_of(tree) if not self.get(n)]
                    if missing:
                        found += [("error", c.name, f"there is no column '{n}'") for n in missing]
                    elif c.type not in ("int", "float"):
                        found.append(("error", c.name, "a computed column must be numeric"))
                    elif all(n in units for n in (c.name, *columns_of(tree))):
                        made = unit_of(tree, units)
                        if not made.compatible(units[c.name]):
                            found.append(("error", c.name, f"the formula gives {made.describe()}, the column is declared {units[c.name].describe()}"))
                        for n in columns_of(tree):
                            if n in computed and n not in done:
                                found.append(("warning", c.name, f"'{n}' is computed later; its stored values are used"))
                except (FormulaError, UnitError) as e:
                    found.append(("error", c.name, str(e)))
            done.add(c.name)
        return found

    def check(self) -> TableSpec:
        """Raise for the first error; no job runs."""
        for severity, column, message in self.problems():
            if severity == "error":
                raise FormulaError(f"{column}: {message}")
        return self
