"""Near-duplicate classes of documents from 64-bit SimHash prints, found by Golay-code fuzzy hashing.

A print is cut into three segments of 22, 21 and 21 bits. Two prints that differ in at most two bits agree on one segment
at least (pigeonhole), and each other segment then differs in at most two bits. Within the perfect binary Golay code of
length 23 a segment decodes to its nearest codeword and, if it lies three bits away, also to the five codewords four bits
away: two words at most two bits apart always share one of these one to six codewords. A key joins the number of the
agreeing segment, its bits, and one codeword index of the next segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.llm.common import materialise, release, table
from unitloom.llm.components import connected_components
from unitloom.llm.near_copies import SHINGLE, THRESHOLD, keyed_texts, near_copies, survey

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code of length 23.
GENERATOR = 0b101011100011
SEGMENTS = ((42, 22), (21, 21), (0, 21))
MAX_BITS = 2
#: A bucket of more prints than this is linked through the words between prints instead of pair by pair.
PAIRWISE_BUCKET = 64

_TABLES: list[np.ndarray] = []


def _remainder(words: np.ndarray) -> np.ndarray:
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where((left >> bit) & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


def golay_tables() -> list[np.ndarray]:
    """For each syndrome: the error pattern of its nearest codeword, and the codewords (as differences from the nearest)
    to list for it, padded by repeating the first."""
    if not _TABLES:
        patterns = np.array([sum(1 << b for b in s) for k in range(4) for s in combinations(range(23), k)], dtype=np.int64)
        errors = np.zeros(2048, dtype=np.int64)
        errors[_remainder(patterns)] = patterns
        messages = np.arange(4096, dtype=np.int64) << 11
        code = messages ^ _remainder(messages)
        light = code[np.bitwise_count(code) == 7]
        near = np.zeros((2048, 6), dtype=np.int64)
        for syndrome, error in enumerate(errors):
            if int(error).bit_count() == 3:
                near[syndrome, 1:] = light[(light & error) == error]
        _TABLES[:] = errors, near
    return _TABLES


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """Six 12-bit codeword indices for each 23-bit word; words less than three bits from the code repeat one index."""
    errors, near = golay_tables()
    syndrome = _remainder(words)
    return ((words ^ errors[syndrome])[:, None] ^ near[syndrome]) >> 11


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the positions of the prints they belong to, without repeats."""
    segments = [((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64) for shift, width in SEGMENTS]
    keys = []
    for i, exact in enumerate(segments):
        index = codeword_indices(segments[(i + 1) % 3])
        key = ((i << 34) | (exact << 12))[:, None] | index
        key[:, 1:][index[:, 1:] == index[:, :1]] = -1
        keys.append(key)
    keys = np.concatenate(keys, axis=1)
    at = np.repeat(np.arange(len(prints)), keys.shape[1])
    flat = keys.ravel()
    return flat[flat >= 0], at[flat >= 0]


def simhash(text: str | None, size: int = 3) -> int:
    """The print of one text; null and blank texts have 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :][:n]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, dtype=np.int64)
    spans = list(zip(starts[:n].tolist(), last.tolist(), strict=True))
    for at in range(0, n, 8192):
        part = np.array([digest(joined[a:b], 42) for a, b in spans[at : at + 8192]], dtype=">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id``, ``print`` (signed 64-bit) of every row, null ids and texts included."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints.view(np.int64))], ["id", "print"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(of, "id long, print long")


def print_links(prints: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` between distinct prints (column ``print``) that differ in at most two bits; enough of them to
    keep together all that such links join, though not every pair.

    Buckets of few prints are compared pair by pair. In a larger bucket every print stands with the words one bit from it;
    two prints are at most two bits apart exactly if they meet at one of these words, where the smallest print is linked
    to the others. So the rows follow the number of prints, whatever the size of a bucket.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            keys, at = fuzzy_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[at])], ["key", "print"])

    keys = prints.select("print").distinct().mapInArrow(keyed, "key long, print long")
    keys = materialise(keys, "simhash-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keys.join(sizes, "key"), "simhash-buckets")
    few = shared.where(F.col("n") <= PAIRWISE_BUCKET)
    pairs = few.select("key", F.col("print").alias("u")).join(few.select("key", F.col("print").alias("v")), "key").where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS))
    crowded = shared.where(F.col("n") > PAIRWISE_BUCKET).select("print").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long") for b in range(64)))
    meeting = crowded.select("print", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("print")))).alias("word"))
    # A word has 65 neighbours at most, so a group here is small.
    stars = meeting.groupBy("word").agg(F.collect_set("print").alias("all")).where(F.size("all") > 1).select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u <> v")
    return pairs.select("u", "v").unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id``, ``print``, ``root``: the smallest id in the class that links of at most two differing bits join.

    Rows with equal prints are one class from the start and only distinct prints are keyed, so thousands of copies cost
    no more than one text. Null and blank texts have print 0 and are linked like any other; a null id keeps its row and
    never is a root, unless the class has no other; repeated rows stay; an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, size), "simhash-prints")
    classes = materialise(prints.groupBy("print").agg(F.min("id").alias("least")), "simhash-classes")
    components = connected_components(print_links(classes)).withColumnRenamed("node", "print")
    linked = materialise(classes.join(components, "print"), "simhash-linked")
    roots = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    moved = linked.join(roots, "root").select("print", "smallest")
    by_print = classes.join(moved, "print", "left").select("print", F.coalesce("smallest", "least").alias("root"))
    return prints.join(by_print, "print").select("id", "print", "root")


def similar_texts(docs: DataFrame, text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``key`` and ``root`` of the texts that have near copies, by similarity instead of print distance: texts of which a share of
    ``threshold`` of the shingles agree (Jaccard) are linked.

    Prints at most two bits apart are found by their Golay keys, as in ``near_duplicates``, and every text is verified
    against the first of its class by all shingles. At a similarity of 0.8 prints differ in ten of 64 bits, beyond
    the reach of any small number of keys, so what these classes leave apart is found by the exact set join of
    ``near_copies``, which compares no pair again that stands in one class. Nulls, blank texts and empty tables as there.
    """
    texts = keyed_texts(docs, text_col)
    surveyed = survey(texts, size)
    prints = materialise(surveyed.where("kind = 0").select("key", F.col("value").alias("print")).distinct(), "text-prints")
    classes = materialise(prints.groupBy("print").agg(F.min("key").alias("least")), "text-classes")
    components = connected_components(print_links(classes)).withColumnRenamed("node", "print")
    rooted = materialise(classes.join(components, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root")), "text-roots")
    first = materialise(rooted.groupBy("root").agg(F.min("least").alias("v"), F.count("*").alias("prints")), "text-firsts")
    pairs = prints.join(rooted, "print").join(first, "root").select(F.col("key").alias("u"), "v").where("u <> v")
    likely = materialise(pairs, "text-pairs")
    release(prints, classes, rooted, first)
    return near_copies(docs, text_col, size, threshold, likely, surveyed)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("root").alias("component_id"))


QUERIES = {"op10_simhash": op10_simhash}
SQL: dict[str, str] = {}
