"""Differences of ordered lists: alignment by longest common subsequence, by position, and moves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lists longer than this are aligned by position.
LONGEST = 2000
CHANGE = "kind string, path string, old_index int, new_index int"


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; of equal choices the one that passes over ``a`` first."""
    n, m = len(a), len(b)
    codes: dict = {}
    x = np.array([codes.setdefault(v, len(codes)) for v in a], dtype=np.int64)
    y = np.array([codes.setdefault(v, len(codes)) for v in b], dtype=np.int64)
    best = np.zeros((n + 1, m + 1), dtype=np.int32)
    for i in range(n - 1, -1, -1):
        step = np.where(y == x[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
        best[i, :-1] = np.maximum.accumulate(step[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def changes(a: list[str], b: list[str], name: str = "") -> list[tuple[str, str, int | None, int | None]]:
    """Kind, path and indexes of what differs. Leftovers between common items are paired in order as modified; what was
    removed and stands elsewhere unchanged has moved."""
    if a == b:
        return []
    shared = common(a, b) if max(len(a), len(b)) <= LONGEST else [(i, i) for i in range(min(len(a), len(b))) if a[i] == b[i]]
    pairs, gone, new = [], [], []
    i = j = 0
    for x, y in [*shared, (len(a), len(b))]:
        left, right = list(range(i, x)), list(range(j, y))
        pairs += zip(left, right, strict=False)
        gone += left[len(right) :]
        new += right[len(left) :]
        i, j = x + 1, y + 1
    # A pair of leftovers whose items both stand elsewhere has moved rather than changed.
    waiting: dict[str, list[int]] = {}
    for k in [*new, *(r for _, r in pairs)]:
        waiting.setdefault(b[k], []).append(k)
    moved: dict[int, int] = {}
    for k in [*gone, *(x for x, _ in pairs)]:
        if waiting.get(a[k]):
            moved[k] = waiting[a[k]].pop(0)
    taken = set(moved.values())
    at = lambda k: f"{name}[{k}]"
    out = [("moved", at(y), x, y) for x, y in moved.items()]
    for x, y in pairs:
        if x not in moved and y not in taken:
            out.append(("modified", at(y), x, y))
        elif x not in moved:
            out.append(("removed", at(x), x, None))
        elif y not in taken:
            out.append(("added", at(y), None, y))
    out += [("removed", at(x), x, None) for x in gone if x not in moved]
    out += [("added", at(y), None, y) for y in new if y not in taken]
    return sorted(out, key=lambda c: (c[3] if c[3] is not None else c[2], c[0]))


def diff_lists(a: DataFrame, b: DataFrame, key: list[str], index: str, item: str, name: str = "") -> DataFrame:
    """``changes`` for each key of two frames of items. The lists of one key come together on both sides."""
    types = dict(a.dtypes)
    shape = ", ".join(f"`{k}` {types[k]}" for k in key) + f", {CHANGE}"
    pick = lambda df: df.select(*key, F.col(index).alias("i"), F.col(item).alias("x"))

    def of(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = changes(left.sort_values("i")["x"].tolist(), right.sort_values("i")["x"].tolist(), name)
        out = pd.DataFrame(rows, columns=["kind", "path", "old_index", "new_index"]).astype({"old_index": "Int32", "new_index": "Int32"})
        own = left if len(left) else right
        for i, k in enumerate(key):
            out.insert(i, k, own[k].iloc[0])
        return out

    return pick(a).groupBy(*key).cogroup(pick(b).groupBy(*key)).applyInPandas(of, shape)


def diff_positions(a: DataFrame, b: DataFrame, key: list[str], index: str, item: str) -> DataFrame:
    """Item by item at equal positions: a native full outer join, for lists of any length."""
    on = [*key, index]
    joined = a.select(*on, F.col(item).alias("old"), F.lit(True).alias("ah")).join(b.select(*on, F.col(item).alias("new"), F.lit(True).alias("bh")), on, "full_outer")
    kind = F.when(F.col("ah").isNull(), "added").when(F.col("bh").isNull(), "removed").otherwise("modified")
    return joined.where(F.col("ah").isNull() | F.col("bh").isNull() | ~F.col("old").eqNullSafe(F.col("new"))).select(*on, kind.alias("kind"), "old", "new")


def moves(removed: DataFrame, added: DataFrame, key: list[str], index: str, item: str) -> DataFrame:
    """Removed and added items of equal content, the first with the first: an equi-join on content and its number."""
    rank = F.row_number().over(Window.partitionBy(*key, "item").orderBy("at"))
    side = lambda df: df.select(*key, F.col(item).alias("item"), F.col(index).alias("at")).withColumn("n", rank)
    return side(removed).withColumnRenamed("at", "old_index").join(side(added).withColumnRenamed("at", "new_index"), [*key, "item", "n"]).select(*key, "item", "old_index", "new_index")


def fingerprint(kind: str, value: bytes) -> str:
    return hashlib.sha256(kind.encode() + value).hexdigest()


def diff_trees(a: list[dict], b: list[dict], path: str = "", into: tuple[str, ...] = ("DATA", "SUMM"), derived: bool = False) -> Iterator[tuple[str, str]]:
    """Kind and path of what differs between two chunk trees (``type``, ``value`` and, for nested ones, ``children``).
    Only chunks named in ``into`` are entered; derived SUMM chunks are left out unless asked for."""
    keep = lambda chunks: [c for c in chunks if derived or c["type"] != "SUMM"]
    left, right = keep(a), keep(b)
    prints = [[fingerprint(c["type"], c["value"]) for c in side] for side in (left, right)]
    for kind, _, x, y in changes(*prints):
        own = right[y] if y is not None else left[x]
        at = f"{path}/{own['type']}[{y if y is not None else x}]".lstrip("/")
        if kind == "modified" and left[x]["type"] == own["type"] and own["type"] in into and "children" in own:
            yield from diff_trees(left[x]["children"], own["children"], at, into, derived)
        elif kind == "modified" and left[x]["type"] != own["type"]:
            yield "removed", f"{path}/{left[x]['type']}[{x}]".lstrip("/")
            yield "added", at
        else:
            yield kind, at
