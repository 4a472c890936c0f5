"""Migrations as data: versions, operations, the shortest plan, and its application to tables, nested values and chunks."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from unitloom.operators import nested, tables
from unitloom.operators.tables import Table


class MigrationError(ValueError):
    """There is no way between two versions, or an operation nobody knows."""


@dataclass(frozen=True)
class Op:
    op: str
    args: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    start: int
    end: int
    ops: tuple[Op, ...]
    note: str = ""


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[Rule, ...] = ()

    @staticmethod
    def from_json(text: str) -> RuleSet:
        raw = json.loads(text)
        return RuleSet(tuple(Rule(r["from"], r["to"], tuple(Op(o["op"], {k: v for k, v in o.items() if k != "op"}) for o in r["ops"]), r.get("note", "")) for r in raw["rules"]))

    def to_json(self) -> str:
        return json.dumps({"rules": [{"from": r.start, "to": r.end, "note": r.note, "ops": [{"op": o.op, **o.args} for o in r.ops]} for r in self.rules]})

    def _routes(self, start: int) -> dict[int, list[Rule]]:
        """The shortest chain of rules to every version that can be reached; of equal ones that of the earlier rules."""
        routes: dict[int, list[Rule]] = {start: []}
        ring = [start]
        while ring:
            following = []
            for version in ring:
                for rule in (r for r in self.rules if r.start == version and r.end not in routes):
                    routes[rule.end] = [*routes[version], rule]
                    following.append(rule.end)
            ring = following
        return routes

    def plan(self, start: int, end: int) -> list[Rule]:
        routes = self._routes(start)
        if end not in routes:
            raise MigrationError(f"no migration leads from version {start} to {end}")
        return routes[end]

    def latest_from(self, start: int) -> int:
        """The newest version that can truly be reached."""
        return max(self._routes(start))

    def checked(self) -> RuleSet:
        """Refuses rules that lead nowhere or use operations that are not known."""
        for rule in self.rules:
            if rule.end <= rule.start:
                raise MigrationError(f"a rule leads from {rule.start} to {rule.end}")
            for op in rule.ops:
                if op.op not in {*TABLE_OPS, *NESTED_OPS, *CHUNK_OPS}:
                    raise MigrationError(f"operation '{op.op}' is not known")
        return self


TABLE_OPS: dict[str, Callable[[Table, dict], Table]] = {
    "rename_column": lambda t, a: tables.rename_column(t, a["from"], a["to"]),
    "set_unit": lambda t, a: tables.set_unit(t, a["column"], a.get("unit")),
    "set_formula": lambda t, a: tables.set_formula(t, a["column"], a.get("expr")),
}
NESTED_OPS = {
    "rename_key": lambda leaves, key, a: nested.rename_key(leaves, a["from"], a["to"]),
    "drop_key": lambda leaves, key, a: nested.unset_path(leaves, a["key"]),
    "set_default": lambda leaves, key, a: nested.set_default(leaves, key, a["key"], a["value"]),
}
#: Chunks are rows with ``type``, ``pos`` and ``value``.
CHUNK_OPS = {
    "rename_chunk": lambda c, a: c.withColumn("type", F.when(F.col("type") == a["from"], a["to"]).otherwise(F.col("type"))),
    "drop_chunk": lambda c, a: c.where(F.col("type") != a["type"]),
    "add_chunk": lambda c, a: c.unionByName(c.groupBy("file").agg((F.max("pos") + 1).alias("pos")).select("file", "pos", F.lit(a["type"]).alias("type"), F.lit(a.get("text", "")).cast("binary").alias("value"))),
}


def _apply(rules: RuleSet, start: int, end: int | None, known: dict, step: Callable, what: str) -> list[str]:
    end = rules.latest_from(start) if end is None else end
    steps = []
    for rule in rules.plan(start, end):
        for op in rule.ops:
            if op.op not in known:
                raise MigrationError(f"migration {rule.start} -> {rule.end} uses operation '{op.op}', which {what} does not have")
            step(op)
            steps.append(f"v{rule.start} -> v{rule.end}: {op.op} {json.dumps(op.args, ensure_ascii=False)}")
    return steps


def migrate_table(table: Table, rules: RuleSet, start: int, end: int | None = None, dry_run: bool = False) -> tuple[Table, list[str]]:
    """The table after the shortest chain of rules and the steps taken; a dry run only names them. Nothing runs half."""
    state = [table]

    def step(op: Op) -> None:
        if not dry_run:
            state[0] = TABLE_OPS[op.op](state[0], op.args)

    steps = _apply(rules, start, end, TABLE_OPS, step, "a table")
    return state[0], steps


def migrate_nested(leaves, key: list[str], rules: RuleSet, start: int, end: int | None = None):
    state = [leaves]
    steps = _apply(rules, start, end, NESTED_OPS, lambda op: state.__setitem__(0, NESTED_OPS[op.op](state[0], key, op.args)), "a nested value")
    return state[0], steps


def migrate_chunks(chunks, rules: RuleSet, start: int, end: int | None = None):
    state = [chunks]
    steps = _apply(rules, start, end, CHUNK_OPS, lambda op: state.__setitem__(0, CHUNK_OPS[op.op](state[0], op.args)), "a chunk list")
    return state[0], steps
