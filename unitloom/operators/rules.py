"""Rules over fields: types, bounds, allowed values, required paths. Violations are rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.plans.spec import quoted

RULE_TYPES = ("null", "bool", "int", "float", "string", "bytes", "list", "map", "any", "datetime")


@dataclass(frozen=True)
class FieldRule:
    path: str
    type: str = "any"
    required: bool = False
    min: float | None = None
    max: float | None = None
    allowed: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.type not in RULE_TYPES:
            raise ValueError(f"'{self.type}' is not a rule type")


def rules_frame(spark: SparkSession, rules: Iterable[FieldRule]) -> DataFrame:
    rows = [(r.path, r.type, r.required, None if r.min is None else float(r.min), None if r.max is None else float(r.max), list(r.allowed) if r.allowed else None) for r in rules]
    return spark.createDataFrame(rows, "rule_path string, rule_type string, required boolean, min double, max double, allowed array<string>")


def collapsed(path: Column) -> Column:
    """Numeric segments as ``*``, so that all items of a list share one rule."""
    return F.array_join(F.transform(F.split(path, "[.]"), lambda s: F.when(s.rlike("^[0-9]+$"), F.lit("*")).otherwise(s)), ".")


def accepts(declared: Column, found: Column) -> Column:
    """Whole numbers pass as floats, not the other way; texts pass as datetimes if they read as one (checked apart)."""
    return (declared == "any") | (declared == found) | ((declared == "float") & (found == "int")) | ((declared == "datetime") & (found == "string"))


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def check_values(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues of flattened values: ``values`` has ``subject``, ``path``, ``type`` and ``text``; each meets the rule of its
    collapsed path. A wrong type is one issue and ends the checks of that value. Rules are joined, and Spark broadcasts
    them if they are small."""
    joined = values.withColumn("rule_path", collapsed(F.col("path"))).join(rules, "rule_path")
    number = F.when(F.col("type").isin("int", "float"), F.col("text").try_cast("double"))
    wrong = ~accepts(F.col("rule_type"), F.col("type")) | (F.col("rule_type") == "datetime") & F.col("text").try_cast("timestamp").isNull()
    issues = F.when(wrong, F.array(F.concat(F.lit("declared "), "rule_type", F.lit(", found "), "type"))).otherwise(
        F.array_compact(F.array(
            F.when(number < F.col("min"), F.concat(_number(number), F.lit(" is below minimum "), _number(F.col("min")))),
            F.when(number > F.col("max"), F.concat(_number(number), F.lit(" is above maximum "), _number(F.col("max")))),
            F.when((F.col("type") == "string") & F.col("allowed").isNotNull() & ~F.array_contains("allowed", F.col("text")), F.concat(F.lit('"'), "text", F.lit('" is not one of '), F.array_join("allowed", ", "))),
        ))
    )
    return joined.select("subject", F.lit("error").alias("severity"), "path", F.explode(issues).alias("message"))


def missing_required(subjects: DataFrame, values: DataFrame, rules: DataFrame) -> DataFrame:
    """Required rules for which a subject has no value: an anti-join of subject and rule with the collapsed paths."""
    wanted = subjects.select("subject").distinct().join(F.broadcast(rules.where("required").select("rule_path")), F.lit(True))  # rules are a declaration, dozens at most
    have = values.select("subject", collapsed(F.col("path")).alias("rule_path")).distinct()
    return wanted.join(have, ["subject", "rule_path"], "left_anti").select("subject", F.lit("error").alias("severity"), F.col("rule_path").alias("path"), F.lit("required value is missing").alias("message"))


def infer_rules(values: DataFrame) -> DataFrame:
    """``rule_path``, ``rule_type`` from the first value of each collapsed path, in order of first appearance."""
    return values.withColumn("rule_path", collapsed(F.col("path"))).groupBy("rule_path").agg(F.min_by("type", F.struct("subject", "pos")).alias("rule_type"))


def check_columns(df: DataFrame, rules: Iterable[FieldRule], key: list[str]) -> DataFrame:
    """Violations of a table's columns: the key, ``path`` and ``message``. One scan, no join: the rules become expressions."""
    types = {"boolean": "bool", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "string": "string", "binary": "bytes"}
    held = {n: types.get(t, "list" if t.startswith("array") else "map" if t.startswith(("map", "struct")) else "string") for n, t in df.dtypes}
    found = []
    for r in rules:
        c = quoted(r.path)
        kind = held.get(r.path)
        if kind is None:
            if r.required:
                found.append(F.struct(F.lit(r.path).alias("path"), F.lit("required value is missing").alias("message")))
            continue
        fits = r.type in ("any", kind) or (r.type, kind) in (("float", "int"), ("datetime", "string"))
        message = lambda text: F.struct(F.lit(r.path).alias("path"), text.alias("message"))  # noqa: E731,B023
        if r.type not in ("null", "any"):
            found.append(F.when(c.isNull(), message(F.lit(f"declared {r.type}, found null"))))
        if not fits:
            found.append(F.when(c.isNotNull(), message(F.lit(f"declared {r.type}, found {kind}"))))
            continue
        if kind in ("int", "float"):
            value = _number(c.cast("double"))
            if r.min is not None:
                found.append(F.when(c < r.min, message(F.concat(value, F.lit(f" is below minimum {r.min:g}")))))
            if r.max is not None:
                found.append(F.when(c > r.max, message(F.concat(value, F.lit(f" is above maximum {r.max:g}")))))
        if kind == "string" and r.allowed is not None:
            found.append(F.when(~c.isin(*r.allowed), message(F.concat(F.lit('"'), c, F.lit(f'" is not one of {", ".join(r.allowed)}')))))
    if not found:
        return df.select(*map(quoted, key), F.lit("").alias("path"), F.lit("").alias("message")).where(F.lit(False))
    return df.select(*map(quoted, key), F.inline(F.array_compact(F.array(*found))))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that stand more than once, with their number."""
    return df.groupBy(*map(quoted, key)).agg(F.count("*").alias("n")).where("n > 1")


def verdict(issues: DataFrame) -> DataFrame:
    """``errors``, ``warnings`` and ``ok``: one row, also without issues."""
    errors = F.count_if(F.col("severity") == "error")
    return issues.agg(errors.alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (errors == 0).alias("ok"))


def key_presence(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys of ``wanted`` that ``have`` lacks."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")
