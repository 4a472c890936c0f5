"""Delimited text and typed JSON tables, in and out."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.functions.scalars import SPARK_TYPES, float_text_column
from unitloom.operators.tables import ROW, Table, infer_types, typed
from unitloom.plans.spec import ColumnSpec, TableSpec, quoted, split_header


class SourceError(ValueError):
    """A source that contradicts itself or what it declares."""


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """The first record, read with the whole record's quotes; a header is small."""
    first = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("header", False).csv(path).limit(1).collect()
    return ["" if v is None else v for v in first[0]] if first else []


def read_delimited(spark: SparkSession, path: str, sep: str = ",", quoted_newlines: bool = True) -> Table:
    """A table whose header cells are ``name (unit) = formula`` and whose types come from every cell.

    Cells are read as text first, since a reader's own inference would lose leading zeros. Short rows get nulls, cells
    beyond the header are dropped. With ``quoted_newlines`` off a file can be split between tasks.
    """
    specs = [split_header(h) for h in _header(spark, path, sep)]
    if not specs:
        return Table(spark.createDataFrame([], f"{ROW} bigint"), TableSpec(()))
    names = [s.name for s in specs]
    if len(set(names)) < len(names):
        raise SourceError(f"column name '{next(n for n in names if names.count(n) > 1)}' is used twice")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    raw = spark.read.schema(schema).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", quoted_newlines).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)
    cells = raw.rdd.zipWithIndex().map(lambda pair: (*pair[0], pair[1])).toDF(f"{schema}, {ROW} bigint")  # no DataFrame function numbers rows in file order
    types = {r["name"]: r["type"] for r in infer_types(cells, names).collect()}  # one row per column
    types = {s.name: "float" if s.expr and types[s.name] == "string" and _hollow(cells, s.name) else types[s.name] for s in specs}
    spec = TableSpec(tuple(ColumnSpec(s.name, types[s.name], s.unit, s.expr) for s in specs))
    return Table(typed(cells, types), spec)


def _hollow(cells: DataFrame, name: str) -> bool:
    return not cells.where(quoted(name).isNotNull() & (F.trim(quoted(name)) != "")).limit(1).count()


def read_json_table(spark: SparkSession, text: str) -> Table:
    """``{"columns": [{name, type, unit, expr, doc}], "rows": [{…}]}``. Unknown keys, values of another type than declared
    and a missing column list are errors; a key that a row lacks is null."""
    raw = json.loads(text)
    if not isinstance(raw, dict) or "columns" not in raw:
        raise SourceError("a table needs a list of columns")
    spec = TableSpec(tuple(ColumnSpec(c["name"], "string" if c["type"] == "str" else c["type"], c.get("unit"), c.get("expr"), c.get("doc")) for c in raw["columns"]))
    fits = {"bool": bool, "int": int, "float": (int, float), "string": str}
    rows = []
    for i, row in enumerate(raw.get("rows", [])):
        if extra := [k for k in row if not spec.get(k)]:
            raise SourceError(f"row {i} has a value for '{extra[0]}', which is no column")
        for c in spec.columns:
            v = row.get(c.name)
            if v is not None and (not isinstance(v, fits[c.type]) or isinstance(v, bool) and c.type != "bool"):
                raise SourceError(f"row {i}: '{c.name}' is declared {c.type}, found {json.dumps(v)}")
        rows.append((*(float(v) if c.type == "float" and (v := row.get(c.name)) is not None else row.get(c.name) for c in spec.columns), i))
    return Table(spark.createDataFrame(rows, ", ".join(f"`{c.name}` {SPARK_TYPES[c.type]}" for c in spec.columns) + f", {ROW} bigint"), spec)


def read_json_rows(spark: SparkSession, path: str, spec: TableSpec) -> Table:
    """Rows of JSON lines under a declaration: for tables of any size. A line that does not fit is an error when read."""
    schema = ", ".join(f"`{c.name}` {SPARK_TYPES[c.type]}" for c in spec.columns)
    return Table(spark.read.schema(schema).option("mode", "FAILFAST").json(path), spec)


def _spelled(table: Table) -> list:
    kinds = {c.name: c.type for c in table.spec.columns}
    return [(float_text_column(quoted(n)) if k == "float" else quoted(n).cast("string")).alias(n) for n, k in kinds.items()]


def write_delimited(table: Table, path: str, sep: str = ",", row: str = ROW, single: bool = True, overwrite: bool = False) -> None:
    """In row order, header with units and formulas; one file, or parts that follow one another."""
    ordered = table.rows.orderBy(row) if row in table.rows.columns else table.rows
    named = ordered.select(*_spelled(table)).toDF(*(c.header for c in table.spec.columns))
    (named.coalesce(1) if single else named).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def delimited_text(table: Table, sep: str = ",", row: str = ROW) -> str:
    """A small table as text."""
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, lineterminator="\n")
    writer.writerow([c.header for c in table.spec.columns])
    ordered = table.rows.orderBy(row) if row in table.rows.columns else table.rows
    for r in ordered.select(*_spelled(table)).toLocalIterator():
        writer.writerow(["" if v is None else v for v in r])
    return out.getvalue()


def spec_json(spec: TableSpec) -> list[dict]:
    keep = lambda c: {"name": c.name, "type": "str" if c.type == "string" else c.type, "unit": c.unit, "expr": c.expr, "doc": c.doc}
    return [{k: v for k, v in keep(c).items() if v is not None} for c in spec.columns]


def json_rows(table: Table) -> DataFrame:
    """One JSON object per row, nulls spelled out; NaN and infinities are null."""
    clean = [(F.when(F.isnan(quoted(c.name)) | (F.abs(quoted(c.name)) == float("inf")), None).otherwise(quoted(c.name)) if c.type == "float" else quoted(c.name)).alias(c.name) for c in table.spec.columns]
    return table.rows.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def write_table(table: Table, path: str, overwrite: bool = False) -> None:
    """Parquet with the declarations beside it; the summary is rebuilt with the data."""
    from unitloom.operators.tables import summary

    mode = "overwrite" if overwrite else "errorifexists"
    table.rows.write.mode(mode).option("compression", "zstd").parquet(f"{path}/rows")
    spark = table.rows.sparkSession
    spark.createDataFrame([(json.dumps(spec_json(table.spec)),)], "columns string").coalesce(1).write.mode(mode).json(f"{path}/spec")
    summary(table).coalesce(1).write.mode(mode).json(f"{path}/summary")


def read_table(spark: SparkSession, path: str) -> Table:
    columns = json.loads(spark.read.schema("columns string").json(f"{path}/spec").first()["columns"])
    spec = TableSpec(tuple(ColumnSpec(c["name"], "string" if c["type"] == "str" else c["type"], c.get("unit"), c.get("expr"), c.get("doc")) for c in columns))
    return Table(spark.read.parquet(f"{path}/rows"), spec)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Without touching the rows."""
    return spark.read.schema("rows bigint, columns bigint, row_groups bigint").json(f"{path}/summary")
