"""Benchmark passages in documents, by a prefix-filtered set join. DataFrame functions alone do the work.

A window is ten consecutive words of an item (or a whole shorter item) and the set of its five-word shingles. A document
holds a window if it holds all its shingles in place, so containment is 1 and the prefix of a window is its rarest shingle
(``n - ceil(1.0 * n) + 1 = 1``): only documents with that shingle can hold it. The place of the shingle fixes where the
window would start (positional bound) and the words left and right of it must be there (length bound); then the words
are compared.

The documents are read once. Within each row a table of bits, one for the hash of each shingle of the benchmark, leaves the
few places that matter, with the words around them; how rare a shingle is among all documents is counted on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.llm.common import materialise, plain_words, table, text_key

WINDOW = 10
SHINGLE = 5
#: Bits of the table that every task receives, at most (2 MB); a fuller table lets more places through to the joins.
MOST_BITS = 1 << 24


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item``, ``win`` (words) for each window of each item; items without words have none."""
    words = items.select(F.col(id_col).cast("string").alias("item"), plain_words(F.col(text_col).cast("string")).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    return words.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - length + 1), lambda s: F.slice("w", s, length))).alias("win"))


def _shingle(words: str, i: Column, size: int) -> Column:
    return F.xxhash64(F.slice(words, i + 1, F.lit(size)))


def _starts(words: str, size: int) -> Column:
    """Where shingles start; nowhere if there are fewer words."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _bits(hashes: DataFrame) -> tuple[Column, int]:
    """A constant array of 64-bit words with a bit for each ``h``, and how many bits it has."""
    n = 1 << max(10, (16 * hashes.count()).bit_length())
    n = min(n, MOST_BITS)
    bit = F.pmod("h", F.lit(n))
    rows = hashes.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits")).collect()
    words = dict.fromkeys(range(n // 64), 0) | {r["word"]: r["bits"] for r in rows}
    return F.from_json(F.lit("[" + ",".join(map(str, words.values())) + "]"), "array<bigint>"), n


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row of ``docs`` as ``id``, ``key`` (of the text), ``n_words``; where windows occur: ``id``, ``key``, ``start``, ``win``;
    and the windows' items: ``win``, ``item``."""
    by_item = materialise(windows_of(items, item_col, item_text_col, window).distinct(), "windows")
    windows = by_item.select("win").distinct()
    sized = windows.select("win", F.least(F.size("win"), F.lit(shingle)).alias("g"))
    sizes = sorted(r.g for r in sized.select("g").distinct().collect())  # of 1 to ``shingle``
    source = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), plain_words(F.col(text_col)).alias("w"))
    if not sizes:
        rows = source.select("id", "key", F.size("w").cast("long").alias("n_words"))
        return rows, source.select("id", "key", F.lit(0).alias("start"), F.col("w").alias("win")).where(F.lit(False)), by_item
    parts = None
    for g in sizes:
        some = sized.where(F.col("g") == g).select("win", F.explode(_starts("win", g)).alias("off")).select("win", "off", _shingle("win", F.col("off"), g).alias("h"))
        parts = some if parts is None else parts.unionByName(some)
    parts = materialise(parts, "window-shingles")
    wanted = materialise(parts.select("h").distinct(), "wanted-shingles")
    bits, n = _bits(wanted)

    def near(g: int) -> Column:
        def listed(i: Column) -> Column:
            bit = F.pmod(_shingle("w", i, g), F.lit(n))
            return F.bit_get(F.get(bits, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int")) == 1

        def place(i: Column) -> Column:
            left = F.greatest(i - (window - 1), F.lit(0))
            return F.struct(i.alias("pos"), _shingle("w", i, g).alias("h"), left.alias("left"), F.slice("w", left + 1, i - left + window).alias("near"))

        return F.transform(F.filter(_starts("w", g), listed), place)

    rows = materialise(source.select("id", "key", F.size("w").cast("long").alias("n_words"), F.concat(*(near(g) for g in sizes)).alias("places")), "shingle-places")
    found = rows.select("id", "key", F.inline("places")).join(wanted, "h", "left_semi")
    rarity = materialise(found.groupBy("h").agg(F.count("*").alias("n")), "shingle-counts")
    # A window one of whose shingles is nowhere occurs nowhere; its rarest shingle has n = 0.
    prefix = parts.join(rarity, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("rarest")).where("rarest.n > 0").select("win", "rarest.h", "rarest.off")
    prefix = materialise(prefix, "window-prefixes")  # both sides are written, so the join may split a frequent shingle
    start = F.col("pos") - F.col("off")
    candidates = rows.select("id", "key", F.inline("places")).join(prefix, "h").where((start >= F.col("left")) & (start - F.col("left") + F.size("win") <= F.size("near")))
    held = candidates.where(F.slice("near", start - F.col("left") + 1, F.size("win")) == F.col("win"))
    return rows.select("id", "key", "n_words"), held.select("id", "key", start.alias("start"), "win").distinct(), by_item


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """For every row of ``docs``: ``id``, ``key``, ``n_words``, ``n_hit`` (words inside windows that occur), ``spans`` (start
    and length in words of each occurrence) and ``items`` (ids as strings, sorted).

    Null and empty texts have no words and no hits; rows with equal id and text get equal results, each its own row; items
    with a null id hit words but are in no list; without items or documents nothing is hit. One row is one document's
    state: what is gathered per document is bounded by its own length.
    """
    every, held, by_item = occurrences(docs, items, id_col, text_col, item_col, item_text_col, window, shingle)
    held = materialise(held, "occurrences")
    spans = held.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("start", F.size("win").alias("length")))).alias("spans"))
    fold = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")), lambda a, s: F.struct(F.greatest(a.end, s.start + s.length).alias("end"), (a.hit + F.greatest(F.lit(0), s.start + s.length - F.greatest(s.start, a.end))).alias("hit")))
    listed = held.select("id", "key", "win").distinct().join(by_item, "win").where("item is not null").groupBy("id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = spans.select("id", "key", "spans", fold.hit.alias("n_hit"))
    hit = spans.join(listed.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "items"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    hit = hit.select(F.col("id").alias("id3"), F.col("key").alias("key3"), "spans", "n_hit", "items")
    joined = every.join(hit, F.col("id").eqNullSafe(F.col("id3")) & (F.col("key") == F.col("key3")), "left")
    return joined.select("id", "key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, with their columns."""
    _, held, _ = occurrences(docs, items, id_col, text_col, item_col, item_text_col)
    hit = materialise(held.select(F.col("id").alias("id2"), F.col("key").alias("key2")).distinct(), "contaminated")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    return packed.join(hit, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left_anti").select("row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op6_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[s:s + least(len(w), 10) - 1] AS win FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(s) WHERE len(w) > 0),
k AS (SELECT DISTINCT len(win) AS k FROM bw),
dw AS (SELECT rid, s, w[s:s + k - 1] AS win FROM d, k, unnest(range(1, len(w) - k + 2)) t(s)),
held AS (SELECT DISTINCT rid, s, win FROM dw SEMI JOIN bw USING (win)),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM held, unnest(range(s, s + len(win))) t(p) GROUP BY rid),
items AS (SELECT rid, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS i FROM held JOIN bw USING (win) WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(i), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(i, ','), '')) AS items_sha256,
  coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
""",
}
QUERIES = {"op6_decontaminate": op6_decontaminate}
