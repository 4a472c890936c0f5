"""Tables: type inference, computed columns, bounded views, summaries, validation, differences and migrations.

A table is a DataFrame and a ``TableSpec``. Row order is a column, ``ROW`` by default, never the order of partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitloom.functions.formula import columns_of, compile_column, parse, to_whole, unit_of
from unitloom.functions.scalars import SPARK_TYPES, blank, float_text, is_bool, is_float, is_int, parse_cell
from unitloom.plans.spec import ColumnSpec, TableSpec, quoted

ROW = "_row"
GROUP_ROWS = 512
SAMPLE = 5
VIEW_ROWS = 20


@dataclass(frozen=True)
class Table:
    rows: DataFrame
    spec: TableSpec

    def select_declared(self) -> DataFrame:
        return self.rows.select(*(quoted(c.name) for c in self.spec.columns))


def infer_types(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``position``, ``name``, ``type`` of text columns from every cell: bool, int, float or else string, in one aggregate.

    Blank cells abstain and a column of nothing else is a string. A type is kept only if no cell would lose by it:
    leading zeros, plus signs and whole numbers beyond 64 bits make a column text.
    """
    names = columns or rows.columns
    tests = {"bool": is_bool, "int": is_int, "float": is_float}
    found = []
    for i, name in enumerate(names):
        cell = quoted(name).cast("string")
        all_ok = {kind: F.coalesce(F.bool_and(F.when(~blank(cell), test(cell))), F.lit(False)) for kind, test in tests.items()}
        chosen = F.when(all_ok["bool"], "bool").when(all_ok["int"], "int").when(all_ok["float"], "float").otherwise("string")
        found.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("name"), chosen.alias("type")))
    return rows.agg(F.array(*found).alias("t")).select(F.inline("t"))


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns as the types found for them; other columns stay."""
    return rows.select(*(parse_cell(quoted(c), types[c]).alias(c) if c in types else quoted(c) for c in rows.columns))


def computed(column: ColumnSpec, spec: TableSpec) -> Column:
    """A computed column's values in its declared unit and type; units are checked here, before any job."""
    units, tree = spec.units(), parse(column.expr or "")
    value = compile_column(tree, units, quoted)
    factor = unit_of(tree, units).factor_to(units[column.name])
    value = value if factor in (1.0, None) else value * F.lit(factor)
    return to_whole(value) if column.type == "int" else value


def recompute(table: Table) -> Table:
    """All computed columns in order of declaration; a formula sees those before it anew and those after it as stored."""
    table.spec.check()
    rows = table.rows
    for column in table.spec.columns:
        if column.expr:
            rows = rows.withColumn(column.name, computed(column, table.spec))
    return Table(rows, table.spec)


def filled(table: Table) -> DataFrame:
    """How many cells of computed columns have a value: one row."""
    made = [c.name for c in table.spec.columns if c.expr]
    counts = sum((F.count(quoted(n)) for n in made), F.lit(0))
    return table.rows.agg(counts.cast("long").alias("filled"))


def view(table: Table, limit: int = VIEW_ROWS, row: str = ROW) -> DataFrame:
    """The first rows by position: a filter on the stored position, which skips Parquet row groups, then a top-k."""
    return table.rows.where(F.col(row) < limit).orderBy(row).limit(limit)


def summary(table: Table) -> DataFrame:
    """``rows``, ``columns``, ``row_groups``."""
    n = F.count("*")
    return table.rows.agg(n.alias("rows"), F.lit(len(table.spec.columns)).cast("long").alias("columns"), F.ceil(n / GROUP_ROWS).cast("long").alias("row_groups"))


def sample(table: Table, row: str = ROW) -> DataFrame:
    return view(table, SAMPLE, row)


def render(table: Table, limit: int = VIEW_ROWS, row: str = ROW, total: int | None = None) -> str:
    """A text table of the first rows, cells cut at 28 characters, floats at 6 decimals."""
    names = [c.name for c in table.spec.columns]
    shown = view(table, limit, row).select(*map(quoted, names)).collect()  # at most ``limit`` rows

    def cell(v) -> str:
        if v is None:
            return ""
        if isinstance(v, float):
            text = float_text(v) if not math.isfinite(v) or abs(v) >= 1e15 else f"{v:.6f}".rstrip("0")
            return text + "0" if text.endswith(".") else text
        text = str(v).lower() if isinstance(v, bool) else str(v)
        return text if len(text) <= 28 else text[:27] + "…"

    grid = [[c.header if len(c.header) <= 28 else c.header[:27] + "…" for c in table.spec.columns], *([cell(v) for v in r] for r in shown)]
    widths = [max(len(r[i]) for r in grid) for i in range(len(names))]
    lines = ["  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in grid]
    lines.insert(1, "  ".join("-" * w for w in widths))
    if total is not None and total > len(shown):
        lines.append(f"… {total - len(shown)} more rows")
    return "\n".join(lines)


def bad_cells(rows: DataFrame, declared: dict[str, str], row: str = ROW) -> DataFrame:
    """Of text-staged columns that declare another type: ``column``, ``declared``, the first ``row`` whose cell does not
    read as it, and its ``cell``. One aggregate over all columns."""
    tests = {"bool": is_bool, "int": is_int, "float": is_float}
    found = []
    for name, kind in declared.items():
        cell = quoted(name).cast("string")
        wrong = ~blank(cell) & ~tests[kind](cell) if kind in tests else F.lit(False)
        first = F.min(F.when(wrong, F.struct(F.col(row).alias("row"), cell.alias("cell"))))
        found.append(F.struct(F.lit(name).alias("column"), F.lit(kind).alias("declared"), first["row"].alias("row"), first["cell"].alias("cell")))
    return rows.agg(F.array(*found).alias("f")).select(F.inline("f")).where("row is not null")


def validate(table: Table, row: str = ROW) -> DataFrame:
    """Issues ``severity``, ``path``, ``message``: of the declarations, and the first mistyped cell of each column that is
    stored as text but declared otherwise."""
    spark = table.rows.sparkSession
    known = spark.createDataFrame([(s, c, m) for s, c, m in table.spec.problems()], "severity string, path string, message string")
    stored = dict(table.rows.dtypes)
    staged = {c.name: c.type for c in table.spec.columns if c.type != "string" and stored.get(c.name) == "string"}
    for c in table.spec.columns:
        held = stored.get(c.name)
        fits = {"bool": ("boolean",), "int": ("bigint", "int", "smallint", "tinyint"), "float": ("double", "float", "bigint", "int"), "string": ("string",)}
        if held and held != "string" and c.type in fits and held not in fits[c.type]:
            known = known.unionByName(spark.createDataFrame([("error", c.name, f"declared {c.type}, stored as {held}")], known.schema))
    if not staged:
        return known
    cells = bad_cells(table.rows, staged, row).select(F.lit("error").alias("severity"), F.col("column").alias("path"), F.format_string("row %d: declared %s, found '%s'", "row", "declared", "cell").alias("message"))
    return known.unionByName(cells)


def column_changes(a: TableSpec, b: TableSpec) -> list[tuple[str, str, str]]:
    """``(kind, column, note)``: removed columns, then changes of type, unit and formula, then added columns."""
    out = [("removed", c.name, f"was {c.type}") for c in a.columns if not b.get(c.name)]
    for c in a.columns:
        if other := b.get(c.name):
            for what, x, y in (("type", c.type, other.type), ("unit", c.unit, other.unit), ("formula", c.expr, other.expr)):
                if x != y:
                    out.append(("modified", c.name, f"{what} {x or 'none'} -> {y or 'none'}"))
    return out + [("added", c.name, f"{c.type}{f' ({c.unit})' if c.unit else ''}") for c in b.columns if not a.get(c.name)]


def diff(a: Table, b: Table, key: list[str] | None = None, row: str = ROW) -> DataFrame:
    """Changed cells and rows: the key, ``kind`` (added, removed, modified), ``column`` (null for whole rows), ``old`` and
    ``new`` as text.

    Rows match by position unless ``key`` names columns. Cells are equal only within one type: a column whose type changed
    differs in all cells that are not null. NaN equals NaN. One full outer equi-join; the whole difference is returned and
    any cap is the reader's.
    """
    on = key or [row]
    shared = [c.name for c in a.spec.columns if b.spec.get(c.name) and c.name not in on]
    types_a, types_b = dict(a.rows.dtypes), dict(b.rows.dtypes)
    side = lambda df, tag: df.select(*(quoted(k).alias(f"{tag}k{i}") for i, k in enumerate(on)), F.lit(True).alias(f"{tag}here"), *(quoted(c).alias(f"{tag}{i}") for i, c in enumerate(shared)))
    condition = F.lit(True)
    for i in range(len(on)):
        condition = condition & F.col(f"ak{i}").eqNullSafe(F.col(f"bk{i}"))
    joined = side(a.rows, "a").join(side(b.rows, "b"), condition, "full_outer")
    cells = []
    for i, c in enumerate(shared):
        x, y = F.col(f"a{i}"), F.col(f"b{i}")
        differs = ~x.eqNullSafe(y) if types_a[c] == types_b[c] else x.isNotNull() | y.isNotNull()
        cells.append(F.when(differs, F.struct(F.lit("modified").alias("kind"), F.lit(c).alias("column"), x.cast("string").alias("old"), y.cast("string").alias("new"))))
    whole = lambda kind: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new")))
    changed = F.array_compact(F.array(*cells)) if cells else F.array().cast("array<struct<kind:string,column:string,old:string,new:string>>")
    what = F.when(F.col("bhere").isNull(), whole("removed")).when(F.col("ahere").isNull(), whole("added")).otherwise(changed)
    keys = [F.coalesce(F.col(f"ak{i}"), F.col(f"bk{i}")).alias(k) for i, k in enumerate(on)]
    return joined.select(*keys, F.inline(what))


def apply_diff(a: Table, changes: DataFrame, b: Table, key: list[str] | None = None, row: str = ROW) -> DataFrame:
    """The rows of ``b`` rebuilt from ``a`` and the changes: rows untouched come from ``a``, touched ones from ``b``."""
    on = key or [row]
    touched = changes.select(*on).distinct()
    names = [c.name for c in b.spec.columns]
    picked = [quoted(c) for c in dict.fromkeys([*on, *names])]
    return a.rows.select(*(p for p in picked)).join(touched, on, "left_anti").unionByName(b.rows.select(*picked).join(touched, on, "left_semi"))


def apply_edit(old: Table, new: DataFrame, key: list[str] | None = None, row: str = ROW) -> tuple[Table, DataFrame]:
    """An edited table under the old declarations, and what changed; the caller writes only if that is not empty."""
    if new.columns != old.rows.columns:
        raise ValueError("an edit keeps the columns; change them with a migration")
    edited = Table(new, old.spec)
    return edited, diff(old, edited, key, row)


def rename_column(table: Table, old: str, new: str) -> Table:
    """A missing column is no error: the operation then does nothing."""
    if not table.spec.get(old):
        return table
    return Table(table.rows.withColumnRenamed(old, new), TableSpec(tuple(replace(c, name=new) if c.name == old else c for c in table.spec.columns)))


def set_unit(table: Table, column: str, unit: str | None) -> Table:
    """The declaration changes, the cells do not."""
    from unitloom.functions.units import Unit

    Unit.parse(unit)
    return Table(table.rows, table.spec.edit(column, unit=unit))


def set_formula(table: Table, column: str, expr: str | None) -> Table:
    if expr:
        columns_of(parse(expr))
    return Table(table.rows, table.spec.edit(column, expr=expr))


def empty(spark, spec: TableSpec) -> Table:
    """A table with its columns and no rows."""
    return Table(spark.createDataFrame([], ", ".join(f"`{c.name}` {SPARK_TYPES[c.type]}" for c in spec.columns) + f", {ROW} bigint"), spec)
