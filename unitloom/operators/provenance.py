"""Hash-linked histories: entries of each subject by ``seq``, with ``tool``, ``action``, ``timestamp``, ``prev_hash``,
``content_hash``, ``key`` and ``signature``. SHA-256 is the hash."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = "1"
FIELDS = ("tool", "action", "timestamp", "prev_hash", "content_hash", "key")


def canonical(entry: dict | None = None) -> Column:
    """All fields but the signature, each with its length as four bytes, little-endian, before it."""

    def part(text: Column) -> Column:
        n = F.octet_length(text)
        size = F.hex(F.shiftleft(n.bitwiseAND(0xFF), 24).cast("bigint").bitwiseAND(0xFFFFFFFF) + F.shiftleft(F.shiftright(n, 8).bitwiseAND(0xFF), 16) + F.shiftleft(F.shiftright(n, 16).bitwiseAND(0xFF), 8) + F.shiftright(n, 24))
        return F.concat(F.unhex(F.lpad(size, 8, "0")), text.cast("binary"))

    return F.concat(part(F.lit(VERSION)), *(part(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS))


def entry_hash() -> Column:
    return F.sha2(canonical(), 256)


def link(entries: DataFrame, subject: str = "subject", seq: str = "seq") -> DataFrame:
    """Entries without ``prev_hash`` chained: a fold over each subject's entries, which come together; a history is small
    against a table."""
    types = dict(entries.dtypes)
    own = [c for c in entries.columns if c != "prev_hash"]
    shape = ", ".join(f"`{c}` {types[c]}" for c in own) + ", prev_hash string"

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        rows = rows.sort_values(seq)
        previous, held = None, []
        for row in rows.to_dict("records"):
            held.append(previous)
            data = b""
            for text in (VERSION, *((previous if f == "prev_hash" else row.get(f)) for f in FIELDS)):
                raw = b"" if text is None or text != text else str(text).encode()
                data += len(raw).to_bytes(4, "little") + raw
            previous = hashlib.sha256(data).hexdigest()
        return rows.assign(prev_hash=held)

    return entries.select(*own).groupBy(subject).applyInPandas(of, shape)


def append(entries: DataFrame, new: DataFrame, subject: str = "subject", seq: str = "seq") -> DataFrame:
    """One new entry for each subject of ``new``, linked to the last that it has; the rest is untouched."""
    last = entries.groupBy(subject).agg(F.max_by(entry_hash(), seq).alias("prev_hash"), F.max(seq).alias("last"))
    linked = new.drop("prev_hash", seq).join(last, subject, "left").withColumn(seq, F.coalesce(F.col("last") + 1, F.lit(0)))
    return entries.unionByName(linked.select(*entries.columns))


def verify(entries: DataFrame, subject: str = "subject", seq: str = "seq", signatures: bool = True) -> DataFrame:
    """By subject: ``entries``, ``signed``, ``unsigned``, ``signers`` (sorted), ``broken_at`` (position of the first break,
    null if sound) and ``why``. Counts stop at the break. Links are checked in parallel with one ``lag``."""
    order = Window.partitionBy(subject).orderBy(seq)
    rows = entries.withColumn("_h", entry_hash()).withColumn("_at", F.row_number().over(order) - 1).withColumn("_before", F.lag("_h").over(order))
    fault = (
        F.when((F.col("_at") == 0) & F.col("prev_hash").isNotNull(), "the first entry points at an entry before it")
        .when((F.col("_at") > 0) & F.col("prev_hash").isNull(), "the entry claims to be the first")
        .when((F.col("_at") > 0) & (F.col("prev_hash") != F.col("_before")), "the link does not match the entry before")
        .when(F.col("key").isNull() != F.col("signature").isNull(), "a key without a signature, or the reverse")
    )
    if signatures:
        fault = F.coalesce(fault, F.when(F.col("key").isNotNull() & ~_signature_ok(F.col("key"), F.col("signature"), canonical()), "the signature does not match"))
    rows = rows.withColumn("_why", fault)
    first = F.min(F.when(F.col("_why").isNotNull(), F.col("_at"))).over(Window.partitionBy(subject))
    rows = rows.withColumn("_first", first)
    sound = F.col("_first").isNull() | (F.col("_at") < F.col("_first"))
    return rows.groupBy(subject).agg(
        F.count("*").alias("entries"), F.count_if(sound & F.col("key").isNotNull()).alias("signed"), F.count_if(sound & F.col("key").isNull()).alias("unsigned"),
        F.array_sort(F.collect_set(F.when(sound, F.col("key")))).alias("signers"), F.min("_first").cast("long").alias("broken_at"), F.min_by("_why", F.when(F.col("_why").isNotNull(), F.col("_at"))).alias("why"),
    )


# Ed25519 by its published definition (RFC 8032), for verification on executors, which hold no key.
_P = 2**255 - 19
_D = -121665 * pow(121666, -1, _P) % _P
_ORDER = 2**252 + 27742317777372353535851937790883648493


def _add(a, b):
    x1, y1, z1, t1 = a
    x2, y2, z2, t2 = b
    m, n, o, p = (y1 - x1) * (y2 - x2) % _P, (y1 + x1) * (y2 + x2) % _P, 2 * t1 * t2 * _D % _P, 2 * z1 * z2 % _P
    e, f, g, h = n - m, p - o, p + o, n + m
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(n: int, a):
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, a)
        a, n = _add(a, a), n >> 1
    return out


def _point(data: bytes):
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    xx = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(xx, (_P + 3) // 8, _P)
    if (x * x - xx) % _P:
        x = x * pow(2, (_P - 1) // 4, _P) % _P
    if y >= _P or (x * x - xx) % _P or (x == 0 and sign):
        raise ValueError("no point")
    x = _P - x if x & 1 != sign else x
    return x, y, 1, x * y % _P


def _packed(a) -> bytes:
    inverse = pow(a[2], -1, _P)
    x, y = a[0] * inverse % _P, a[1] * inverse % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _base():
    y = 4 * pow(5, -1, _P) % _P
    return _point(y.to_bytes(32, "little"))


def _digest(*parts: bytes) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


class Identity:
    """A signing key of 32 secret bytes; made or loaded on purpose, never by the way."""

    def __init__(self, secret: bytes) -> None:
        import hashlib

        if len(secret) != 32:
            raise ValueError("a secret has 32 bytes")
        wide = hashlib.sha512(secret).digest()
        self._scalar = int.from_bytes(wide[:32], "little") & (1 << 254) - 8 | 1 << 254
        self._prefix = wide[32:]
        self.key = _packed(_times(self._scalar, _base())).hex()

    @staticmethod
    def generate() -> Identity:
        return Identity(os.urandom(32))

    @staticmethod
    def discover(variable: str = "UNITLOOM_IDENTITY", path: str | None = None) -> Identity | None:
        """From the environment (hexadecimal), else a file, else none."""
        if text := os.environ.get(variable):
            return Identity(bytes.fromhex(text.strip()))
        if path and os.path.exists(path):
            with open(path) as f:
                return Identity(bytes.fromhex(f.read().strip()))
        return None

    def sign(self, data: bytes) -> str:
        r = _digest(self._prefix, data) % _ORDER
        point = _packed(_times(r, _base()))
        s = (r + _digest(point, bytes.fromhex(self.key), data) * self._scalar) % _ORDER
        return (point + s.to_bytes(32, "little")).hex()


def verify_signature(key: str, signature: str, data: bytes) -> bool:
    try:
        public, signed = bytes.fromhex(key), bytes.fromhex(signature)
        if len(public) != 32 or len(signed) != 64:
            return False
        s = int.from_bytes(signed[32:], "little")
        if s >= _ORDER:
            return False
        h = _digest(signed[:32], public, data) % _ORDER
        return _packed(_times(s, _base())) == _packed(_add(_point(signed[:32]), _times(h, _point(public))))
    except ValueError:
        return False


def _signature_ok(key: Column, signature: Column, data: Column) -> Column:
    @F.pandas_udf("boolean")
    def ok(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, s, d in batches:
            yield pd.Series([None if a is None or b is None else verify_signature(a, b, bytes(c)) for a, b, c in zip(k, s, d, strict=True)])

    return F.coalesce(ok(key, signature, data), F.lit(False))


def content_hash(df: DataFrame, order: list[str], columns: list[str], group: int = 4096) -> DataFrame:
    """One hash over rows in order: groups of ``group`` positions are hashed on their own and the group hashes hashed again,
    so no task holds the table. ``order`` starts with a 0-based position."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    groups = df.groupBy(F.floor(F.col(order[0]) / group).alias("g")).agg(F.array_sort(F.collect_list(F.struct(*order, row.alias("h")))).alias("rows")).select("g", F.sha2(F.array_join(F.transform("rows", lambda r: r.h), ""), 256).alias("h"))
    wide = groups.groupBy(F.floor(F.col("g") / group).alias("gg")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "h"))), lambda r: r.h), ""), 256).alias("h"))
    return wide.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gg", "h"))), lambda r: r.h), ""), 256).alias("content_hash"))


def chain_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "subject string, seq int, tool string, action string, timestamp string, prev_hash string, content_hash string, key string, signature string")
