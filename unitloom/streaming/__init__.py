"""Recomputing, checking and flattening work row by row, so they also take a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitloom.operators.rules import FieldRule, check_columns
from unitloom.operators.tables import Table, recompute
from unitloom.plans.spec import TableSpec


def recompute_stream(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Computed columns of a stream; units are checked before it starts."""
    return recompute(Table(rows, spec)).rows


def violations_stream(rows: DataFrame, rules: Iterable[FieldRule], key: list[str]) -> DataFrame:
    """Violations as they arrive."""
    return check_columns(rows, rules, key)


def windowed_violations(rows: DataFrame, rules: Iterable[FieldRule], key: list[str], time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Violations by path and window of event time; rows later than the watermark are left out and its state with them."""
    found = check_columns(rows.withWatermark(time, late), rules, [*key, time])
    return found.groupBy(F.window(time, window).alias("window"), "path").agg(F.count("*").alias("violations"))
