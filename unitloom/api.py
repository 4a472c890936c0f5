"""One entry for each task: read, write, convert, view, summarise, compare, check and change what files hold."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.functions.scalars import parse_argument
from unitloom.operators import documents, images, nested, provenance, rules, tables, texts
from unitloom.operators.rules import FieldRule
from unitloom.operators.tables import Table
from unitloom.plans.capabilities import Capabilities
from unitloom.plans.migrations import RuleSet, migrate_nested, migrate_table
from unitloom.sources import configs, container, delimited, pdf
from unitloom.sources.registry import FORMATS, UnsupportedSource, extension, preferred, preview_html, preview_text

KEY = ["file"]


def read(spark: SparkSession, path: str, kind: str | None = None) -> Table | DataFrame:
    """A table, or the leaves, sections, blocks or pixels of every file that ``path`` names, with its name as ``file``."""
    ext = extension(path)
    wanted, _ = preferred(ext, kind)
    match wanted.name:
        case "table" if ext == "json":
            return delimited.read_json_table(spark, spark.read.option("wholetext", True).text(path).first()["value"])
        case "table":
            return delimited.read_delimited(spark, path, "\t" if ext == "tsv" else ",")
        case "config":
            return configs.read_config(spark, path, ext)
        case "image":
            files = spark.read.format("binaryFile").load(path)
            return images.from_png(files.select(F.col("path").alias("image"), "content"))
        case "document" if ext == "pdf":
            files = spark.read.format("binaryFile").load(path)
            return documents.from_plain(pdf.read_pdf(files.select(F.col("path").alias("file"), "content")), KEY)
    whole = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    if wanted.name == "text":
        return texts.segment(whole, KEY, markdown=ext == "md")
    return documents.from_markdown(whole, KEY) if ext == "md" else documents.from_plain(whole, KEY)


def write(held: Table | DataFrame, path: str, kind: str, overwrite: bool = False) -> None:
    """Existing targets are kept unless told otherwise."""
    ext, mode = extension(path), "overwrite" if overwrite else "errorifexists"
    preferred(ext, kind, "exports")
    if isinstance(held, Table):
        if ext == "json":
            delimited.json_rows(held).select(F.col("json").alias("value")).write.mode(mode).text(path)
        else:
            delimited.write_delimited(held, path, "\t" if ext == "tsv" else ",", overwrite=overwrite)
        return
    if kind == "config":
        out = configs.config_text(held, KEY, ext)
    elif kind == "text":
        out = texts.to_text(held, KEY)
    elif kind == "document" and ext == "pdf":
        pdf.to_pdf(documents.pin(held, KEY), KEY[0]).write.mode(mode).parquet(path)
        return
    elif kind == "document":
        out = documents.to_markdown(held, KEY) if ext == "md" else documents.to_plain(held, KEY)
    elif kind == "image":
        images.to_png(held).write.mode(mode).parquet(path)
        return
    else:
        raise UnsupportedSource(f"nothing writes {kind} as .{ext}")
    out.select(F.col("text").alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def convert(spark: SparkSession, source: str, target: str, kind: str | None = None, overwrite: bool = False) -> None:
    wanted, _ = preferred(extension(source), kind)
    write(read(spark, source, wanted.name), target, wanted.name, overwrite)


def view(held: Table | DataFrame, limit: int = tables.VIEW_ROWS) -> DataFrame:
    """The first rows, sections, blocks or leaves."""
    if isinstance(held, Table):
        return tables.view(held, limit)
    order = next((c for c in ("pos", "sec", "block") if c in held.columns), None)
    return held.orderBy(*(c for c in ("file", order) if c in held.columns)).limit(limit) if order else held.limit(limit)


def summary(held: Table | DataFrame) -> DataFrame:
    if isinstance(held, Table):
        return tables.summary(held)
    for column, of in (("pos", nested.summarise), ("sec", texts.summarise), ("block", documents.summarise)):
        if column in held.columns:
            return of(held, KEY)
    return images.summarise(held)


def preview(title: str, held: Table | DataFrame, as_html: bool = False) -> str:
    """From the summary alone."""
    first = summary(held).first()
    facts = first.asDict() if first else {}
    return preview_html(title, facts) if as_html else preview_text(title, facts)


def info(spark: SparkSession, path: str) -> DataFrame:
    return container.info(spark, path)


def formats() -> list[tuple[str, str, tuple[str, ...], tuple[str, ...]]]:
    return [(f.name, f.about, f.imports, f.exports) for f in FORMATS]


def diff(a: Table | DataFrame, b: Table | DataFrame, key: list[str] | None = None) -> DataFrame:
    """Things of different kinds are not compared."""
    if isinstance(a, Table) != isinstance(b, Table):
        raise ValueError("a table and something else cannot be compared")
    if isinstance(a, Table) and isinstance(b, Table):
        return tables.diff(a, b, key)
    if a.columns != b.columns:
        raise ValueError("files of different kinds cannot be compared")
    if "pos" in a.columns:
        return nested.diff(a, b, key or KEY)
    from unitloom.operators.alignment import diff_lists

    index, content = ("sec", "section") if "sec" in a.columns else ("block", "block")
    item = F.to_json(F.struct("kind", "level", "lang", "text")).alias("item")
    side = lambda df: df.select(*(key or KEY), index, item)
    return diff_lists(side(a), side(b), key or KEY, index, "item", content)


def validate(held: Table | DataFrame, own: list[FieldRule] | None = None, declared: Capabilities | None = None, policy: Capabilities | None = None) -> DataFrame:
    """Issues ``severity``, ``path``, ``message`` of content, rules, declaration and policy."""
    spark = held.rows.sparkSession if isinstance(held, Table) else held.sparkSession
    shape = "severity string, path string, message string"
    pick = lambda df, path: df.select("severity", F.col(path).cast("string").alias("path"), "message")
    if isinstance(held, Table):
        found = tables.validate(held)
        if own:
            key = [tables.ROW] if tables.ROW in held.rows.columns else [held.spec.columns[0].name]
            found = found.unionByName(rules.check_columns(held.rows, own, key).select(F.lit("error").alias("severity"), "path", "message"))
    elif "pos" in held.columns:
        found = nested.repeated_paths(held, KEY).select(F.lit("error").alias("severity"), "path", F.lit("the path stands twice").alias("message"))
        if own:
            values = held.withColumnRenamed("file", "subject")
            frame = rules.rules_frame(spark, own)
            found = found.unionByName(pick(rules.check_values(values, frame), "path")).unionByName(pick(rules.missing_required(values, values, frame), "path"))
    elif "sec" in held.columns:
        found = pick(texts.validate(held, KEY), "sec")
    else:
        found = pick(documents.validate(held, KEY), "block")
    extra = [*(declared.lint() if declared else []), *(declared.exceeds(policy) if declared and policy else [])]
    return found.unionByName(spark.createDataFrame(extra, shape)) if extra else found


def migrate(held: Table | DataFrame, own: RuleSet, start: int, end: int | None = None, dry_run: bool = False):
    """What is migrated, and the steps; a dry run changes nothing."""
    own.checked()
    if isinstance(held, Table):
        return migrate_table(held, own, start, end, dry_run)
    moved, steps = migrate_nested(held, KEY, own, start, end)
    return (held if dry_run else moved), steps


def recompute(table: Table) -> Table:
    return tables.recompute(table)


def get_path(leaves: DataFrame, path: str) -> DataFrame:
    return nested.get_path(leaves, path)


def set_path(leaves: DataFrame, path: str, text: str) -> DataFrame:
    """The argument as a shell gives it: JSON if it reads as such."""
    return nested.set_path(leaves, KEY, path, parse_argument(text))


def unset_path(leaves: DataFrame, path: str) -> DataFrame:
    return nested.unset_path(leaves, path)


def pin(blocks: DataFrame) -> DataFrame:
    return documents.pin(blocks, KEY)


def thumbnail(pictures: DataFrame, edge: int | None = None) -> DataFrame:
    return images.thumbnails(pictures, edge)


def verify_chain(entries: DataFrame) -> DataFrame:
    return provenance.verify(entries)


def empty_table(spark: SparkSession, columns: list[str]) -> Table:
    """From header cells; numbers must be declared with a type later."""
    from unitloom.plans.spec import TableSpec, split_header

    return tables.empty(spark, TableSpec(tuple(split_header(c) for c in columns)))


def starter(kind: str, title: str = "", width: int = 64, height: int = 64) -> Any:
    """What a new file of a kind begins with."""
    match kind:
        case "config":
            return {}
        case "text" | "document":
            return f"# {title}\n" if title else ""
        case "image":
            return bytes(width * height * 4)
    raise UnsupportedSource(f"there is no starter for {kind}")
