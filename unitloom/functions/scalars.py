"""Scalar functions: reading cells, previews, counts and spellings."""

from __future__ import annotations

import json
import math
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Names of column types as declared in headers and specifications, and Spark's.
SPARK_TYPES = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "str": "string"}
_INT, _FLOAT = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def trimmed(cell: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(cell, r"(?U)^\s+|\s+$", "")


def blank(cell: Column) -> Column:
    return cell.isNull() | (trimmed(cell) == "")


def _label_like(t: Column) -> Column:
    """Digits that are an identifier rather than a number: a leading zero or plus sign, a dot at either end."""
    return t.rlike(r"^-?0\d") | t.startswith("+") | t.startswith(".") | t.startswith("-.") | t.endswith(".")


def is_bool(cell: Column) -> Column:
    return F.lower(trimmed(cell)).isin("true", "false")


def is_int(cell: Column) -> Column:
    t = trimmed(cell)
    return t.rlike(_INT) & ~_label_like(t) & t.try_cast("bigint").isNotNull()


def is_float(cell: Column) -> Column:
    """A number that a double holds without losing digits of a whole number."""
    t = trimmed(cell)
    whole = t.rlike(_INT)
    return t.rlike(_FLOAT) & ~_label_like(t) & (~whole | t.try_cast("bigint").isNotNull())


def parse_cell(cell: Column, kind: str) -> Column:
    """A text cell as a value of ``kind``; blank cells are null."""
    t = trimmed(cell)
    kept = F.when(t != "", t)
    if kind == "bool":
        return F.lower(kept) == "true"
    return kept if kind in ("string", "str") else kept.try_cast(SPARK_TYPES[kind])


def float_text(x: float | None) -> str | None:
    """The shortest spelling that reads back as the same double, never in exponent form; whole numbers keep one decimal."""
    if x is None:
        return None
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "inf" if x > 0 else "-inf"
    if x == int(x) and abs(x) < 1e15:
        return f"{x:.1f}"
    digits = repr(x)
    if "e" not in digits:
        return digits[:-2] if digits.endswith(".0") else digits
    mantissa, exponent = digits.split("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa.startswith("-") else ("", mantissa)
    whole, _, part = mantissa.partition(".")
    shift = int(exponent)
    if shift >= 0:
        part = part.ljust(shift, "0")
        return sign + whole + part[:shift] + (f".{part[shift:]}" if part[shift:] else "")
    return sign + "0." + "0" * (-shift - 1) + whole + part


@F.pandas_udf(StringType())
def float_text_column(x: pd.Series) -> pd.Series:
    """Only exports need this spelling, which Spark's cast does not give."""
    return x.map(lambda v: None if v is None or pd.isna(v) and not isinstance(v, float) else float_text(float(v)))


def preview(text: Column, limit: int = 60) -> Column:
    """Text in quotes, cut after ``limit`` characters with an ellipsis."""
    return F.concat(F.lit('"'), F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text), F.lit('"'))


def first_line(text: Column, limit: int = 60) -> Column:
    """The first line that is not blank, cut with an ellipsis."""
    line = trimmed(F.regexp_extract(text, r"(?U)(\S[^\n]*)", 1))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


def words(text: Column) -> Column:
    """How many words, parted by Unicode white space."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long")


def rfc3339(seconds: Column) -> Column:
    """Unix seconds as UTC time; independent of the session's zone. Years beyond four digits are spelled in full, without a
    sign, and those before year 0 with a minus, as by ``strftime``."""
    day, second = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    date = F.date_from_unix_date(day)
    year = F.year(date).cast("string")
    year = F.when(F.year(date).between(0, 999), F.lpad(year, 4, "0")).otherwise(year)
    return F.concat(year, F.lit("-"), two(F.month(date)), F.lit("-"), two(F.day(date)), F.lit("T"), two(F.floor(second / 3600)), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60), F.lit("Z"))


def hex_encode(data: Column) -> Column:
    return F.lower(F.hex(data))


def hex_decode(text: Column) -> Column:
    """Null for an odd number of digits or anything that is not hexadecimal."""
    return F.when(text.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(text))


def byte_size(n: Column) -> Column:
    """Bytes for a reader: B, KB, MB, GB in steps of 1024, one decimal above bytes."""
    units = ["KB", "MB", "GB", "TB"]
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(units, 1):
        scaled = F.concat(F.replace(F.format_number(n / float(1024**i), 1), F.lit(","), F.lit("")), F.lit(f" {unit}"))
        out = out.when(n < 1024 ** (i + 1), scaled) if i < len(units) else out.otherwise(scaled)
    return out


def to_linear(level: Column) -> Column:
    """An sRGB level of 0 to 255 as linear light of 0 to 1."""
    c = level / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def from_linear(light: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), light))
    s = F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)
    return F.round(s * 255.0).cast("int")


def parse_argument(text: str) -> Any:
    """A command-line value: JSON if it reads as such, else the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def shell_text(value: Any) -> str:
    """A value as a shell would take it: texts bare, the rest as JSON."""
    if isinstance(value, str):
        return value
    if isinstance(value, float):
        return float_text(value) or ""
    return json.dumps(value, ensure_ascii=False)
