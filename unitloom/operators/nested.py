"""Nested values as rows of dotted paths: flatten and rebuild, get, set and unset, summaries, checks and differences.

A leaf is a row: the key, ``pos`` (order in the source), ``path``, ``segs`` (its segments, each a name or an index), ``type``
and ``text`` (its value; null for null). Empty lists and maps are leaves.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitloom.functions.scalars import float_text

LEAF = "pos int, path string, segs array<struct<is_index:boolean,key:string,idx:int>>, type string, text string"
SEGMENTS = pa.list_(pa.struct([("is_index", pa.bool_()), ("key", pa.string()), ("idx", pa.int32())]))


def type_name(value: Any) -> str:
    for kind, name in ((bool, "bool"), (int, "int"), (float, "float"), (str, "string"), (bytes, "bytes"), (list, "list"), (dict, "map")):
        if isinstance(value, kind):
            return name
    return "null"


def leaf_text(value: Any) -> str | None:
    match value:
        case None:
            return None
        case bool():
            return "true" if value else "false"
        case float():
            return float_text(value)
        case bytes():
            return value.hex()
        case list():
            return "[]"
        case dict():
            return "{}"
    return str(value)


def walk(value: Any, path: tuple = ()) -> Iterator[tuple[tuple, Any]]:
    """Leaves depth first, in order."""
    items: Iterable = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    inner = False
    for key, item in items:
        inner = True
        yield from walk(item, (*path, key))
    if not inner:
        yield path, value


def limit_ints(value: Any) -> Any:
    """Whole numbers beyond 64 bits become floats, as in the sources that hold them."""
    if isinstance(value, dict):
        return {k: limit_ints(v) for k, v in value.items()}
    if isinstance(value, list):
        return [limit_ints(v) for v in value]
    return float(value) if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63 else value


def flatten_value(value: Any) -> list[tuple]:
    rows = []
    for pos, (path, leaf) in enumerate(walk(value)):
        segs = [{"is_index": isinstance(s, int), "key": None if isinstance(s, int) else s, "idx": s if isinstance(s, int) else None} for s in path]
        rows.append((pos, ".".join(map(str, path)), segs, type_name(leaf), leaf_text(leaf)))
    return rows


def flatten(df: DataFrame, key: list[str], text: str, read=json.loads) -> DataFrame:
    """The leaves of every row's text; ``read`` parses one. A null text has none; one that cannot be read is an error."""
    types = dict(df.dtypes)
    shape = ", ".join(f"`{k}` {types[k]}" for k in key) + f", {LEAF}"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, leaves = [], []
            for i, cell in enumerate(batch.column(len(key)).to_pylist()):
                if cell is not None:
                    found = flatten_value(limit_ints(read(cell)))
                    own += [i] * len(found)
                    leaves += found
            pos, path, segs, kind, text = zip(*leaves, strict=True) if leaves else ((),) * 5
            columns = [pa.array(pos, pa.int32()), pa.array(path, pa.string()), pa.array(segs, SEGMENTS), pa.array(kind, pa.string()), pa.array(text, pa.string())]
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(key)]), *columns], [*key, "pos", "path", "segs", "type", "text"])

    return df.select(*key, text).mapInArrow(of, shape)


def flatten_json(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """The top level of JSON objects, in native expressions: ``path``, ``type``, ``text``. For data of one level of scalars,
    where order does not count; deeper values are left as JSON."""
    pairs = F.map_entries(F.from_json(F.col(text), "map<string,string>"))
    v = F.col("e.value")
    kind = F.when(v.isNull(), "null").when(v.rlike(r"^-?\d+$"), "int").when(v.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "float").when(v.isin("true", "false"), "bool").when(v.startswith("["), "list").when(v.startswith("{"), "map").otherwise("string")
    return df.select(*key, F.explode(pairs).alias("e")).select(*key, F.col("e.key").alias("path"), kind.alias("type"), v.alias("text"))


def leaf_value(kind: str, text: str | None) -> Any:
    match kind:
        case "null":
            return None
        case "bool":
            return text == "true"
        case "int":
            return int(text or 0)
        case "float":
            return float(text or 0)
        case "bytes":
            return bytes.fromhex(text or "")
        case "list":
            return []
        case "map":
            return {}
    return text


def rebuild(leaves: Iterable[tuple[list, str, str | None]]) -> Any:
    """The value again from (segments, type, text) in order. Lists are filled with null up to an index; a path that goes on
    below a scalar or mixes names and indexes at one place is an error."""
    root: list[Any] = [None]
    for segs, kind, text in leaves:
        holder: Any = root
        at: Any = 0
        for s in segs:
            name = int(s["idx"]) if s["is_index"] else s["key"]
            wanted = list if s["is_index"] else dict
            inner = holder[at]
            if inner is None:
                inner = holder[at] = wanted()
            if not isinstance(inner, wanted):
                raise ValueError(f"the path does not fit what stands at '{name}'")
            if wanted is list:
                inner.extend([None] * (int(name) + 1 - len(inner)))
            elif name not in inner:
                inner[name] = None
            holder, at = inner, name
        if holder[at] is not None:
            raise ValueError("a path stands twice")
        holder[at] = leaf_value(kind, text)
    return root[0]


def _spell(value: Any) -> Any:
    if isinstance(value, float) and not math.isfinite(value):
        return float_text(value)
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, dict):
        return {k: _spell(v) for k, v in value.items()}
    return [_spell(v) for v in value] if isinstance(value, list) else value


def unflatten(leaves: DataFrame, key: list[str], write=None) -> DataFrame:
    """``text`` of every key: its leaves come together, in order, and are written (as JSON unless told otherwise)."""
    types = dict(leaves.dtypes)
    shape = ", ".join(f"`{k}` {types[k]}" for k in key) + ", text string"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            cells = batch.column(len(key))
            held, kinds, values = cells.values.flatten()
            names = held.values.flatten()
            every = [{"is_index": a, "key": b, "idx": c} for a, b, c in zip(*(n.to_pylist() for n in names), strict=True)]
            ends = held.offsets.to_pylist()
            leaves = [(every[a:b], kind, text) for a, b, kind, text in zip(ends[:-1], ends[1:], kinds.to_pylist(), values.to_pylist(), strict=True)]
            edges = cells.offsets.to_pylist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                value = rebuild(leaves[a:b])
                texts.append(write(value) if write else json.dumps(_spell(value), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(key)], pa.array(texts, pa.string())], [*key, "text"])

    # A null place comes last.
    gathered = leaves.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").isNull().alias("last"), "pos", "segs", "type", "text"))).alias("leaves"))
    return gathered.select(*key, F.transform("leaves", lambda r: F.struct(r["segs"].alias("segs"), r["type"].alias("type"), r["text"].alias("text"))).alias("leaves")).mapInArrow(of, shape)


def under(path: Column, prefix: str) -> Column:
    """The prefix itself or anything below it."""
    return (path == prefix) | path.startswith(prefix + ".") if prefix else F.lit(True)


def get_path(leaves: DataFrame, path: str) -> DataFrame:
    return leaves.where(F.col("path") == path)


def unset_path(leaves: DataFrame, path: str) -> DataFrame:
    return leaves.where(~under(F.col("path"), path))


def set_path(leaves: DataFrame, key: list[str], path: str, value: Any) -> DataFrame:
    """Each key's leaf at ``path`` replaced in place or, where there is none, appended. A numeric segment of a new path is
    an index if the key has siblings with indexes at that place."""
    kind, text = type_name(value), leaf_text(value)
    hit = F.col("path") == path
    kept = leaves.where(hit | ~under(F.col("path"), path))
    changed = kept.select(*key, "pos", "path", "segs", F.when(hit, kind).otherwise(F.col("type")).alias("type"), F.when(hit, F.lit(text)).otherwise(F.col("text")).alias("text"))
    parts = path.split(".")
    segs = []
    for i, s in enumerate(parts):
        sibling = F.max(F.when((F.size("segs") > i) & (F.array_join(F.slice(F.split("path", "[.]"), 1, i), ".") == ".".join(parts[:i])), F.get("segs", F.lit(i)).is_index))
        as_index = F.coalesce(sibling, F.lit(False)) if s.isdigit() else F.lit(False)
        segs.append(F.struct(as_index.alias("is_index"), F.when(~as_index, F.lit(s)).alias("key"), F.when(as_index, F.lit(int(s) if s.isdigit() else 0)).alias("idx")))
    lacking = leaves.groupBy(*key).agg(F.max("pos").alias("last"), F.bool_or(hit).alias("has"), F.array(*segs).alias("segs")).where("not has")
    return changed.unionByName(lacking.select(*key, (F.col("last") + 1).alias("pos"), F.lit(path).alias("path"), "segs", F.lit(kind).alias("type"), F.lit(text).cast("string").alias("text")))


def diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """``kind``, ``path``, ``old``, ``new``, ``note`` by key: one full outer equi-join on key and path. A change of type is
    a change, also where both read alike."""
    on = [*key, "path"]
    side = lambda df, n: df.select(*on, F.struct("type", "text").alias(n))
    joined = side(a, "a").join(side(b, "b"), on, "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    retyped = F.when(F.col("a.type") != F.col("b.type"), F.concat(F.lit("type "), "a.type", F.lit(" -> "), "b.type"))
    return joined.select(*on, kind.alias("kind"), F.col("a.text").alias("old"), F.col("b.text").alias("new"), retyped.alias("note"))


def summarise(leaves: DataFrame, key: list[str]) -> DataFrame:
    """``leaves``, ``depth``, counts by type (sorted) and top-level names in order."""
    kinds = leaves.groupBy(*key, "type").agg(F.count("*").alias("n")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("types"))
    top = leaves.where(F.size("segs") > 0).groupBy(*key, F.split("path", "[.]")[0].alias("name")).agg(F.min("pos").alias("pos")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    sizes = leaves.groupBy(*key).agg(F.count("*").alias("leaves"), F.max(F.size("segs")).alias("depth"))
    return sizes.join(kinds, key).join(top, key, "left")


def repeated_paths(leaves: DataFrame, key: list[str]) -> DataFrame:
    return leaves.groupBy(*key, "path").agg(F.count("*").alias("n")).where("n > 1")


def rename_key(leaves: DataFrame, old: str, new: str) -> DataFrame:
    """``old`` and all below it under ``new``."""
    moved = F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30))
    depth = len(old.split("."))
    head = F.array(*(F.struct(F.lit(False).alias("is_index"), F.lit(s).alias("key"), F.lit(None).cast("int").alias("idx")) for s in new.split(".")))
    hit = under(F.col("path"), old)
    segs = F.when(hit, F.concat(head, F.slice("segs", F.lit(depth + 1), F.greatest(F.lit(0), F.size("segs") - depth)))).otherwise(F.col("segs"))
    return leaves.withColumn("segs", segs).withColumn("path", F.when(hit, moved).otherwise(F.col("path")))


def set_default(leaves: DataFrame, key: list[str], path: str, value: Any) -> DataFrame:
    """A value for the keys that have nothing at or below ``path``."""
    have = leaves.groupBy(*key).agg(F.bool_or(under(F.col("path"), path)).alias("has"), F.max("pos").alias("last")).where("not has")
    segs = F.array(*(F.struct(F.lit(False).alias("is_index"), F.lit(s).alias("key"), F.lit(None).cast("int").alias("idx")) for s in path.split(".")))
    return leaves.unionByName(have.select(*key, (F.col("last") + 1).alias("pos"), F.lit(path).alias("path"), segs.alias("segs"), F.lit(type_name(value)).alias("type"), F.lit(leaf_text(value)).cast("string").alias("text")))


def renumber(leaves: DataFrame, key: list[str]) -> DataFrame:
    """Positions from 0 without gaps, in order."""
    return leaves.withColumn("pos", F.row_number().over(Window.partitionBy(*key).orderBy("pos", "path")) - 1)
