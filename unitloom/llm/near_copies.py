"""Classes of near copies: all pairs of texts whose sets of shingles reach a Jaccard similarity, by an exact set join.

The shingles of a text are ordered by how common they are, then by hash. Two sets of n shingles that reach similarity t share
one of the first ``n - ceil(t * n) + 1`` of either (prefix filter); their sizes differ by the factor t at most (length
filter), and from the first shingle that both hold enough must follow in both (positional filter). Any common order gives the
same pairs, so only the speed depends on how commonness is counted. What passes is verified on the texts themselves.

Only the classes matter, so every text of a bucket is first compared with the smallest one there, and in buckets that still
hold many classes with another one in each of a few rounds; so a large group of near copies is joined by a few
comparisons a text. Pairs that this leaves in different classes are then compared one by one.

A sketch of parities precedes the comparison by all shingles: bits that an odd number of a text's shingles falls on. No more
of them differ between two texts than shingles that only one of them has, so no pair that reaches t is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitloom.llm.common import TEXTS, materialise, release, text_key, tidy
from unitloom.llm.components import connected_components
from unitloom.llm.suffix_dedup import grams, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
#: A shingle found so often in one chunk of hashes is reported; the most frequent of those come last in the order.
CHUNK_HASHES, LEAST_IN_CHUNK, MOST_COMMON = 2_000_000, 4, 100_000
#: Buckets in which more pairs a text than this are in different classes are compared with one text at a time before all their
#: pairs: in so many rounds at most, and so many that find no link.
CROWDED, ROUNDS, IDLE = 4, 6, 2
#: After the first rounds, texts that each text of such a bucket is compared with in a round.
FIRST, CHOSEN = 2, 8
#: Bits of the table that tells texts whose hashes are asked for; it lets a few others pass.
ASKED_BITS = 1 << 24


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    """The runs of ``size`` words; a shorter text is one shingle, also one without words."""
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = word_hashes(text)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()))], dtype=np.uint64).view(np.int64)
    return np.unique(grams(words, size).view(np.int64))


def _majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # so many ones fit a byte
        ones += np.add.reduce(np.unpackbits(hashes[at : at + 255].astype(">i8").view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def parities(hashes: np.ndarray) -> bytes:
    """One bit for each remainder of the hashes, set if an odd number has it; as many bits as hashes, or up to twice."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_apart(one: bytes, other: bytes) -> int:
    """At least so many shingles are in one of two texts alone, by their ``parities``."""
    short, long = sorted((one, other), key=len)
    folded = np.bitwise_xor.reduce(np.frombuffer(long, np.uint8).reshape(-1, len(short)), axis=0)
    return int(np.bitwise_count(folded ^ np.frombuffer(short, np.uint8)).sum())


def survey(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """In one pass, for each distinct text its SimHash print (``kind`` 0: ``key``, ``value``) with the
    number ``n`` of its shingles and their parities (``sketch``), and the counts of shingles that are
    common within a chunk of hashes (``kind`` 1: hash as ``key``, count as ``value``)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, keys: np.ndarray, values: np.ndarray, sizes: list[int] | None = None, sketches: list[bytes] | None = None) -> pa.RecordBatch:
            nulls = [None] * len(keys)
            columns = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(values), pa.array(nulls if sizes is None else sizes, pa.int32()), pa.array(nulls if sketches is None else sketches, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["kind", "key", "value", "n", "sketch"])

        def counted(kept: list[np.ndarray]) -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= LEAST_IN_CHUNK
            return rows(1, found[often], n[often].astype(np.int64))

        seen: set[int] = set()  # copies within a task count once
        kept, held = [np.zeros(0, np.int64)], 0
        for batch in batches:
            keys, prints, sizes, sketches = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key not in seen:
                    seen.add(key)
                    own = shingle_hashes(text.as_py(), size)
                    keys.append(key)
                    prints.append(_majority(own))
                    sizes.append(len(own))
                    sketches.append(parities(own))
                    kept.append(own)
                    held += len(own)
                    if held > CHUNK_HASHES:
                        yield counted(kept)
                        kept, held = [np.zeros(0, np.int64)], 0
            yield rows(0, np.array(keys, np.int64), np.array(prints, np.int64), sizes, sketches)
        yield counted(kept)

    return materialise(texts.mapInArrow(tidy(of), "kind int, key long, value long, n int, sketch binary"), "near-copy-survey", "kind", batch=TEXTS)


def _common(surveyed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of common shingles in ascending order, and their counts."""
    counts = surveyed.where("kind = 1").groupBy("key").agg(F.sum("value").alias("n"))
    rows = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).toPandas()
    order = np.argsort(rows["key"].to_numpy(np.int64))
    return rows["key"].to_numpy(np.int64)[order], rows["n"].to_numpy(np.int64)[order]


def _prefixes(texts: DataFrame, size: int, threshold: float, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """``h``, ``key``, ``at`` (place of the shingle in the order), ``n`` (shingles of the text) for each prefix shingle."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task are keyed once
        for batch in batches:
            own, keys, sizes = [np.zeros(0, np.int64)], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                h = shingle_hashes(text.as_py(), size)
                rank = np.zeros(len(h), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    rank = np.where(common[at] == h, counts[at], 0)
                own.append(h[np.lexsort((h, rank))][: len(h) - math.ceil(round(threshold * len(h), 9)) + 1])
                keys.append(key)
                sizes.append(len(h))
            length = np.array([len(x) for x in own[1:]], dtype=np.int64)
            at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            columns = [np.concatenate(own), np.repeat(np.array(keys, np.int64), length), at.astype(np.int32), np.repeat(np.array(sizes, np.int32), length)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "key", "at", "n"])

    return texts.mapInArrow(tidy(of), "h long, key long, at int, n int")


def _sharing(met: DataFrame) -> DataFrame:
    """``u``, ``v`` for pairs that share prefix shingles, with the sizes, their number and the last places."""
    ends = F.max("at").alias("at"), F.max("at2").alias("at2")
    return met.groupBy(F.col("key").alias("u"), F.col("key2").alias("v")).agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("n2").alias("n2"), *ends)


def _possible(threshold: float, one: Callable[[str], Column], other: Callable[[str], Column], before: Column) -> Column:
    """Length and positional filter for the shingle at place ``at`` of one text of ``n`` and of the other: ``before`` shingles are
    shared ahead of it, and no more than what follows can be."""
    n, n2 = one("n"), other("n")
    needed = F.ceil(F.lit(threshold / (1 + threshold)) * (n + n2) - 1e-6)
    rest = F.least(n - one("at"), n2 - other("at"))
    return (F.least(n, n2) >= F.lit(threshold) * F.greatest(n, n2) - 1e-6) & (before + rest >= needed)


def _asked(keys: DataFrame) -> np.ndarray:
    """A table of ``ASKED_BITS`` bits, whatever the number of ``keys``: set at the remainder of each."""
    place = F.pmod("key", F.lit(ASKED_BITS)) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    found = np.zeros((ASKED_BITS // 32768, 4096), dtype=np.uint8)
    for row in parts.toLocalIterator():
        found[row["part"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return found.ravel()


def _among(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``texts`` with one of ``keys``, and a few others, written."""
    bits = _asked(keys)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                place = part.column(0).to_numpy() & (ASKED_BITS - 1)
                yield part.filter(pa.array((bits[place >> 3] >> (place & 7) & 1).astype(bool)))

    return materialise(texts.mapInArrow(tidy(of), "key long, text string"), "near-copy-texts", batch=TEXTS)


def _held(texts: DataFrame, pairs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``row`` and ``hashes`` of all shingles of the texts in ``pairs`` (and of a few others), and one ``row`` for each ``key``: so
    neither texts nor hashes need be moved to tell copies, which stand once for each task."""
    bits = _asked(pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                place = part.column(0).to_numpy() & (ASKED_BITS - 1)
                part = part.filter(pa.array((bits[place >> 3] >> (place & 7) & 1).astype(bool)))
                keys, found = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        found.append(shingle_hashes(text.as_py(), size).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.binary())], ["key", "hashes"])

    found = texts.mapInArrow(tidy(hashed), "key long, hashes binary")
    held = materialise(found.withColumn("row", F.monotonically_increasing_id()), "near-copy-hashes", batch=TEXTS)
    return held, materialise(held.groupBy("key").agg(F.min("row").alias("row")), "near-copy-chosen")


def _plausible(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` that may reach the threshold by their sketches: 1 - t of 1 + t of all shingles may be in one text alone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (1 - threshold) / (1 + threshold) * (batch.column(2).to_numpy().astype(float) + batch.column(3).to_numpy()) + 1e-6
            good = pa.array([least_apart(a.as_py(), b.as_py()) <= m for a, b, m in zip(batch.column(4), batch.column(5), most, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], ["u", "v"])

    sides = pairs.select("u", "v")
    for end in ("u", "v"):
        sides = sides.join(sketches.select(F.col("key").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
    return materialise(sides.select("u", "v", "n_u", "n_v", "sketch_u", "sketch_v").mapInArrow(tidy(of), "u long, v long"), "near-copy-plausible", batch=TEXTS)


def _verified(pairs: DataFrame, texts: DataFrame, size: int, threshold: float, sketches: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``u``, ``v``: keys) whose texts reach the threshold, by all their shingles."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(one.as_buffer(), np.int64), np.frombuffer(other.as_buffer(), np.int64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= round(threshold * (len(a) + len(b) - both), 9))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], ["u", "v"])

    likely = _plausible(pairs, sketches, threshold)
    if likely.isEmpty():
        return likely
    held, chosen = _held(texts, likely, size)
    named = likely
    for end, row in (("u", "row_u"), ("v", "row_v")):
        named = named.join(chosen.select(F.col("key").alias(end), F.col("row").alias(row)), end)
    sides = named.join(held.select(F.col("row").alias("row_u"), F.col("hashes").alias("a")), "row_u").join(held.select(F.col("row").alias("row_v"), F.col("hashes").alias("b")), "row_v")
    found = materialise(sides.select("u", "v", "a", "b").mapInArrow(tidy(of), "u long, v long"), "near-copy-links", batch=TEXTS)
    release(likely, held, chosen)
    return found


def keyed_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(text_key(text).alias("key"), text.alias("text"))


def _classes(links: DataFrame) -> DataFrame:
    return materialise(connected_components(links), "near-copy-classes")


def _ties(classes: DataFrame) -> DataFrame:
    """Links that make up the same classes, one for each member: with new ones beside them these settle in few rounds."""
    return classes.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def _with_roots(entries: DataFrame, classes: DataFrame) -> DataFrame:
    return entries.join(classes.withColumnRenamed("node", "key"), "key", "left").select(*entries.columns, F.coalesce("root", "key").alias("root"))


def _open_buckets(entries: DataFrame) -> DataFrame:
    """The entries of buckets that hold several classes, with the bucket's least entry."""
    own = F.struct("key", "at", "n", "root")
    apart = entries.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.array(F.min(own)).alias("some")).where("lo <> hi").select("h", "some")
    # Both sides are written, so that the join may split a bucket that most texts are in.
    return entries.join(materialise(apart, "near-copy-least"), "h")


def _crowded(rooted: DataFrame, turn: int) -> DataFrame:
    """The entries of buckets of more than ``CROWDED`` pairs a text in different classes, with ``some`` entries that each ``turn``
    chooses by other hashes of the keys: large buckets then mostly share them. At first one, as that joins most; then
    ``CHOSEN``, which meet the few texts left apart."""
    sizes = rooted.groupBy("h", "root").count().groupBy("h").agg(F.sum("count").alias("all"), F.sum(F.col("count") * F.col("count")).alias("own"))
    many = sizes.where(F.col("all") * F.col("all") - F.col("own") > 2 * CROWDED * F.col("all")).select("h")
    least = [F.min_by(F.struct("key", "at", "n", "root"), F.xxhash64("key", F.lit(turn * CHOSEN + k))) for k in range(1 if turn < FIRST else CHOSEN)]
    chosen = rooted.groupBy("h").agg(F.array_distinct(F.array(*least)).alias("some"))
    return rooted.join(materialise(chosen.join(many, "h"), "near-copy-least"), "h")


def _with_some(entries: DataFrame, threshold: float) -> DataFrame:
    """``u``, ``v`` (the lesser key) for entries and ``some`` beside them in other classes, where the filters let the pair pass."""
    good = F.filter("some", lambda s: (s.root != F.col("root")) & _possible(threshold, F.col, s.getField, F.lit(0)))
    met = entries.select(F.col("key").alias("u"), F.explode(F.transform(good, lambda s: s.key)).alias("v")).distinct()
    return met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_copies(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, likely: DataFrame | None = None, surveyed: DataFrame | None = None) -> DataFrame:
    """``key`` (``text_key`` of a text) and ``root`` (the smallest key of its class) for every text in a class of two or
    more; links of a similarity of ``threshold`` or more join a class.

    ``likely`` (``u``, ``v``: keys) are pairs to verify first; what they join is not compared again. ``surveyed`` is a
    ``survey`` of the texts. Equal texts have one key and are no class by themselves. Blank texts are alike; texts shorter
    than a shingle are alike if their words are equal. An empty table gives no rows.
    """
    texts = keyed_texts(docs, text_col)
    surveyed = surveyed if surveyed is not None else survey(texts, size)
    sketches = materialise(surveyed.where("kind = 0").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "near-copy-sketches")
    entries = materialise(_prefixes(texts, size, threshold, *_common(surveyed)), "near-copy-entries", batch=TEXTS)
    several = materialise(entries.groupBy("h").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("h"), "near-copy-several")
    shared = materialise(entries.join(several, "h").distinct(), "near-copy-buckets")
    release(entries, several)
    none = shared.select(F.col("key").alias("u"), F.col("key").alias("v")).where(F.lit(False))
    known = _verified(likely, texts, size, threshold, sketches) if likely is not None else none
    classes = _classes(known)
    rooted = materialise(_with_roots(shared, classes), "near-copy-buckets")
    compared = materialise(_with_some(_open_buckets(rooted), threshold), "near-copy-stars")
    release(rooted)
    classes = _classes(_ties(classes).unionByName(_verified(compared, texts, size, threshold, sketches)))
    large = materialise(shared.join(shared.groupBy("h").count().where(F.col("count") > 2 * CROWDED).select("h"), "h"), "near-copy-large")
    few = _among(texts, large.select("key"))  # so that a round need not read all texts
    idle = 0
    for turn in range(ROUNDS):
        rooted = materialise(_with_roots(large, classes), "near-copy-buckets")
        star = materialise(_with_some(_crowded(rooted, turn), threshold).join(compared, ["u", "v"], "left_anti"), "near-copy-stars")
        release(rooted)
        if star.isEmpty():
            release(star)
            break
        links = _verified(star, few, size, threshold, sketches)
        before, compared = compared, materialise(compared.unionByName(star), "near-copy-compared")
        release(before, star)
        if links.isEmpty():
            idle += turn >= FIRST
            if idle == IDLE:
                break
            continue
        idle = 0
        classes = _classes(_ties(classes).unionByName(links))
    release(large, few)
    # Pairs of a bucket that these comparisons leave in different classes. Here all shared prefix shingles of a pair count.
    rooted = materialise(_with_roots(shared, classes), "near-copy-buckets")
    release(shared)
    left = materialise(_open_buckets(rooted).drop("some"), "near-copy-open")
    release(rooted)
    other = left.select("h", *(F.col(c).alias(f"{c}2") for c in ("key", "at", "n", "root")))
    # The first shingle that both hold passes the filter if the pair is alike; those that follow pass up to some place.
    pairs = _sharing(left.join(other, "h").where("key > key2 and root <> root2").where(_possible(threshold, F.col, lambda c: F.col(f"{c}2"), F.lit(0))))
    some = pairs.where(_possible(threshold, F.col, lambda c: F.col(f"{c}2"), F.col("shared") - 1))
    some = materialise(some.select("u", "v").join(compared, ["u", "v"], "left_anti"), "near-copy-pairs")
    release(left)
    more = _verified(some, texts, size, threshold, sketches)
    release(some, compared, sketches)
    return connected_components(_ties(classes).unionByName(more)).select(F.col("node").alias("key"), "root")
