"""Passages that repeat within and across documents, found with a sparse suffix array.

Every run of ``min_words`` words has one minimiser: its first ``GRAM``-word gram of least hash. Only suffixes at minimisers
are kept, and of these, by a first sort, only those whose leading gram a neighbour shares. They are then sorted by the
words that follow (as a sequence of one symbol a word, a 48-bit hash) and compared with their neighbours: the common prefix
is how far a match extends to the right, and the order of the words before the suffix, the nearest first, tells how far
it extends to the left. A suffix and another make a passage of ``min_words`` words wherever both extensions add up to that;
adjoining ones make up one maximal passage. The sorted order is dealt out by ranges of suffix and place, so a passage in a
third of all documents is spread over many tasks; where a range ends within a group of suffixes that share their leading
gram, the windows of that group meet in a join instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.llm.common import TEXTS, materialise, release, table, text_key, tidy

MIN_WORDS = 50
GRAM = 20
#: Bytes of a word's hash by which suffixes are ordered and compared, word by word.
SYMBOL = 6
CONTEXT = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("least", pa.int32()), ("most", pa.int32()), ("follow", pa.binary()), ("before", pa.binary())])
MATCH = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("first", pa.int64()), ("again", pa.bool_()), ("span", pa.binary()), ("wins", pa.list_(pa.binary())), ("places", pa.list_(pa.struct([("id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32())])))])
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(4096, 2 * n)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(hashes))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up, dtype=np.uint64)))
    mixed = (total[size:] - total[:-size]) * down[:n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ (mixed >> np.uint64(29))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
SLAB = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word (run of non-blank characters, A-Z as a-z) in order. Words are hashed all at once, by
    sums of their bytes times powers, in slabs of a text that end at blanks."""
    data = (text or "").encode().lower()
    found, at = [], 0
    while at < len(data):
        stop = min(len(data), at + SLAB)
        while stop < len(data) and not _BLANK[data[stop]]:
            stop += 1
        part = np.frombuffer(data, dtype=np.uint8, count=stop - at, offset=at)
        edge = np.flatnonzero(np.diff(_BLANK[part], prepend=True, append=True))
        begin, end = edge[::2], edge[1::2]
        up, down = _powers(len(part))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((part + np.uint64(1)) * up, dtype=np.uint64)))
        found.append(_mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        at = stop
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def minimisers(hashes: np.ndarray, min_words: int = MIN_WORDS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams, and for each window of ``min_words`` words the position of its minimiser."""
    keys = grams(hashes, gram)
    width = min_words - gram + 1
    if len(keys) < width:
        return keys, np.zeros(0, dtype=np.int64)
    parts = []
    for at in range(0, len(keys) - width + 1, 1 << 16):  # bounded also for one very long text
        part = np.lib.stride_tricks.sliding_window_view(keys[at : at + (1 << 16) + width - 1], width)
        parts.append(part.argmin(axis=1) + np.arange(at, at + len(part)))
    return keys, np.concatenate(parts)


def _blank_parted(text: str) -> Column:
    """How many words a text has."""
    return F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), ""))


def _frame(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("th"), text.alias("text"))


def _sparse_suffixes(frame: DataFrame, min_words: int, gram: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, places = [], np.zeros(batch.num_rows, dtype=np.int64), []
            for i, text in enumerate(batch.column(2)):
                every, at = minimisers(word_hashes(text.as_py()), min_words, gram)
                at = np.unique(at)
                keys.append(every[at])
                places.append(at)
                counts[i] = len(at)
            own = np.repeat(np.arange(batch.num_rows), counts)
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            place = np.concatenate(places).astype(np.int32) if places else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(place)], ["key", "id", "th", "pos"])

    return frame.mapInArrow(tidy(of), "key long, id long, th long, pos int")


def _sharing(suffixes: DataFrame) -> DataFrame:
    """The suffixes whose key a neighbour in the sorted order has. At the ends of a sorted part, where the neighbour is in
    another part, a suffix is kept: what follows compares whole windows, so one suffix too many does no harm."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, until its right neighbour is known
        before: int | None = None  # the key left of it
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()[0]
            key = rows.column(0).to_numpy()
            same = key[1:] == key[:-1]
            keep = np.concatenate(([before is None or key[0] == before], same)) | np.concatenate((same, [False]))
            yield rows.filter(pa.array(np.concatenate((keep[:-1], [False])))).select(["id", "th", "pos"])
            held = rows.slice(rows.num_rows - 1)
            before = int(key[-2]) if len(key) > 1 else before
        if held is not None:
            yield held.select(["id", "th", "pos"])

    parts = max(1, int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = suffixes.repartitionByRange(parts, "key", "id", "th", "pos").sortWithinPartitions("key", "id", "th", "pos")
    return ordered.mapInArrow(tidy(of), "id long, th long, pos int")


def _contexts(marked: DataFrame, min_words: int, gram: int) -> DataFrame:
    """The suffix at each marked minimiser, as far as its windows reach: ``follow`` (symbols of the words from it on),
    ``before`` (of the words left of it, the nearest first), and ``least`` and ``most``, the distances of its windows'
    starts. A window belongs to its minimiser alone, wherever it occurs, so no comparison is made twice."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(CONTEXT.names, r, strict=True)) for r in rows], CONTEXT)

        for batch in batches:
            for doc, th, text, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if (doc, th) == last:  # a repeated row is the same text
                    continue
                last = doc, th
                hashes = word_hashes(text.as_py())
                _, at = minimisers(hashes, min_words, gram)
                symbols = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :SYMBOL])
                ahead, back = symbols.tobytes(), symbols[::-1].tobytes()
                places = np.sort(marks.values.to_numpy())
                first, final = np.searchsorted(at, places, "left"), np.searchsorted(at, places, "right") - 1
                for p, a, z in zip(places.tolist(), first.tolist(), final.tolist(), strict=True):
                    begin = (len(hashes) - p) * SYMBOL
                    rows.append((doc, th, p, p - z, p - a, ahead[p * SYMBOL : (z + min_words) * SYMBOL], back[begin : begin + (p - a) * SYMBOL]))
                if len(rows) >= 4096:
                    yield out()
                    rows.clear()
        if rows:
            yield out()

    return marked.mapInArrow(tidy(of), "id long, th long, pos int, least int, most int, follow binary, before binary")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row of ``width`` symbols for each cell, padded with zero bytes."""
    cells = column.to_pylist()
    return np.frombuffer(b"".join(c.ljust(width * SYMBOL, b"\0") for c in cells), dtype=np.uint8).reshape(len(cells), width * SYMBOL)


def _common_prefix(rows: np.ndarray) -> np.ndarray:
    """How many symbols each row has in common with the row before it; 0 for the first."""
    found = np.zeros(len(rows), dtype=np.int64)
    for at in range(1, len(rows), 4096):
        apart = rows[at : at + 4096] != rows[at - 1 : at - 1 + len(rows[at : at + 4096])]
        found[at : at + 4096] = np.where(apart.any(axis=1), apart.argmax(axis=1), rows.shape[1]) // SYMBOL
    return found


def extend(follow: np.ndarray, before: np.ndarray, least: np.ndarray, most: np.ndarray, rank: np.ndarray, min_words: int) -> np.ndarray:
    """For each suffix (a row, in suffix order) and each distance of its windows' starts: the row of least ``rank`` whose window
    there has the same words, or -1 if no other row has.

    Rows that agree on ``min_words - d`` words to the right stand next to each other in the order, so common prefixes of
    neighbours tell them; rows that agree on d words to the left do so in the order of what stands before.
    """
    n, reach = len(follow), before.shape[1] // SYMBOL
    right = _common_prefix(follow)
    order = np.argsort(before.view(f"S{before.shape[1]}").ravel(), kind="stable")
    left = _common_prefix(before[order])
    by_rank = np.argsort(rank, kind="stable")
    place = np.empty(n, dtype=np.int64)
    place[by_rank] = np.arange(n)
    out = np.full((n, reach + 1), -1, dtype=np.int32)
    run, side = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for d in range(reach + 1):
        at = np.nonzero((least <= d) & (d <= most))[0]
        if len(at) < 2:
            continue
        run[:] = np.cumsum(right < min_words - d)
        side[order] = np.cumsum(left < d) if d else 0
        _, which, count = np.unique(run[at] * (n + 1) + side[at], return_inverse=True, return_counts=True)
        first = np.full(len(count), n)
        np.minimum.at(first, which, place[at])
        again = count[which] > 1
        out[at[again], d] = by_rank[first[which[again]]]
    return out


def _matches(contexts: DataFrame, min_words: int, gram: int) -> DataFrame:
    """Sorted suffixes compared with their neighbours. ``span`` null: ``start`` to ``stop`` stands elsewhere as well, first in
    ``first``. Suffixes that share their leading gram with the first or last of a sorted part may go on in another
    part: of these, those with the same words stand side by side and are given out as one, with their ``places`` (1,024 at most
    in a row), the distance of their first window (``stop``) and the hashes of all their words (``span``) and of each window
    (``wins``), to be compared by joins."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = min_words - gram

        def done(rows: pa.Table, whole: bool) -> Iterator[pa.RecordBatch]:
            doc, th, pos = rows["id"].combine_chunks(), rows["th"].to_numpy(), rows["pos"].to_numpy().astype(np.int64)
            least, most = rows["least"].to_numpy().astype(np.int64), rows["most"].to_numpy().astype(np.int64)
            if not whole:
                for at in range(0, rows.num_rows, 1024):
                    part = rows.slice(at, 1024)
                    columns = [part[name].to_pylist() for name in ("follow", "before", "least", "most", "id", "th", "pos")]
                    found: list[dict] = []
                    last = None
                    for ahead, back, lo, hi, own, key, p in zip(*columns, strict=True):
                        if (ahead, back) != last:
                            last = ahead, back
                            wins = [xxhash.xxh3_128_digest(back[: d * SYMBOL] + ahead[: (min_words - d) * SYMBOL], d) for d in range(lo, hi + 1)]
                            found.append({"stop": lo, "span": xxhash.xxh3_128_digest(back + ahead, lo << 32 | hi), "wins": wins, "places": []})
                        found[-1]["places"].append({"id": own, "th": key, "pos": p})
                    yield pa.RecordBatch.from_pylist(found, MATCH)
                return
            number = doc.fill_null(0).to_numpy()
            rank = np.empty(len(pos), dtype=np.int64)
            rank[np.lexsort((pos, th, number, doc.is_valid().to_numpy(zero_copy_only=False)))] = np.arange(len(pos))
            first = extend(_matrix(rows["follow"], min_words), _matrix(rows["before"], reach), least, most, rank, min_words)[:, ::-1]
            i, back = np.nonzero(first >= 0)
            if not len(i):
                return
            found, start = first[i, back], pos[i] - (reach - back)
            fresh = np.concatenate(([True], (i[1:] != i[:-1]) | (start[1:] != start[:-1] + 1) | (found[1:] != found[:-1])))
            head = np.nonzero(fresh)[0]
            tail = np.concatenate((head[1:], [len(i)])) - 1
            own = pa.array(i[head])
            yield pa.RecordBatch.from_arrays([doc.take(own), pa.array(th[i[head]]), pa.array(start[head].astype(np.int32)), pa.array((start[tail] + min_words).astype(np.int32)), doc.take(pa.array(found[head])), pa.array(found[head] != i[head]), *(pa.nulls(len(head), MATCH.field(name).type) for name in ("span", "wins", "places"))], MATCH.names)

        held: list[pa.RecordBatch] = []  # from the start of a group on
        size, opening, before = 0, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            lead = [f[: gram * SYMBOL] for f in rows["follow"].to_pylist()]
            place = list(zip(rows["id"].to_pylist(), rows["th"].to_pylist(), rows["pos"].to_pylist(), strict=True))
            rows = rows.filter(pa.array([True] + [place[k] != place[k - 1] for k in range(1, len(place))]))
            lead = [lead[0]] + [lead[k] for k in range(1, len(place)) if place[k] != place[k - 1]]
            cuts = [0] + [k for k in range(1, len(lead)) if lead[k] != lead[k - 1]]
            if opening and len(cuts) > 1:
                yield from done(rows.slice(0, cuts[1]), False)
                opening, cuts = False, cuts[1:]
            if not opening and len(cuts) > 1:
                yield from done(rows.slice(cuts[0], cuts[-1] - cuts[0]), True)
            rest = rows.slice(cuts[-1] if not opening else 0)
            if opening and rest.num_rows >= 16_384:  # a group that fills the part need not be held
                yield from done(rest.slice(0, rest.num_rows - 1), False)
                rest = rest.slice(rest.num_rows - 1)
            held = rest.combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held), False)

    parts = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["follow", "before", "id", "th", "pos"]
    return contexts.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(tidy(of), "id long, th long, start int, stop int, first long, again boolean, span binary, wins array<binary>, places array<struct<id:bigint,th:bigint,pos:int>>")


def _spans(gathered: DataFrame, min_words: int) -> DataFrame:
    """Adjoining matches of a text joined to passages."""
    shape = "id long, th long, spans array<struct<start:int,stop:int,redundant:boolean,first_ids:array<long>>>"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("redundant", pa.bool_()), ("first_ids", pa.list_(pa.int64()))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for cell in part.column(2).to_pylist():
                    spans: list[dict] = []
                    for row in sorted(cell, key=lambda r: (r["start"], r["stop"])):
                        # Windows start from row.start to row.stop - min_words; the next window in line continues a passage.
                        if spans and spans[-1]["redundant"] == row["again"] and row["start"] <= spans[-1]["stop"] - min_words + 1:
                            spans[-1]["stop"] = max(spans[-1]["stop"], row["stop"])
                            spans[-1]["first_ids"].add(row["first"])
                        else:
                            spans.append({"start": row["start"], "stop": row["stop"], "redundant": row["again"], "first_ids": {row["first"]}})
                    found.append([s | {"first_ids": sorted(s["first_ids"] - {None})} for s in spans])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], ["id", "th", "spans"])

    return gathered.mapInArrow(tidy(of), shape)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``id``, ``th`` (hash of the text) and ``spans`` for each text with a passage of ``min_words`` words or more that
    occurs elsewhere, in another text or again in its own.

    Spans are in words (runs of non-blank characters, A-Z as a-z): ``start``, ``stop``, whether the passage is
    ``redundant`` (some occurrence stands before it, by id, hash of the text and position) and ``first_ids``, the ids of the
    texts where it stands first. Exact copies of a text are not expanded: each is one redundant span over all its words,
    its first id that of the smallest copy. Texts that are null, blank or shorter than ``min_words`` have no spans; rows
    with equal id and text are one text; a null id sorts first; an empty table gives no rows.
    """
    frame = _frame(docs, id_col, text_col)
    same = ["th", "size", "crc"]
    rows = frame.select("id", "th", F.length("text").alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc"), _blank_parted("text").alias("n")).where(F.col("n") >= min_words)
    classes = rows.groupBy(*same).agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count_if(F.col("id").isNull()).alias("nulls"), F.first("n").alias("n"))
    several = materialise(classes.where("not (least <=> most) or (nulls > 0 and least is not null)"), "copy-classes")
    copies = rows.join(several.drop("n"), same).where("not (id <=> least)").select("id", "th", "n", "least").distinct()
    copies = materialise(copies, "copies")

    suffixes = materialise(_sparse_suffixes(frame, min_words, gram), "suffixes", batch=TEXTS)
    marked = _sharing(suffixes).groupBy("id", "th").agg(F.collect_set("pos").alias("at"))
    own = copies.select(F.col("id").alias("id2"), F.col("th").alias("th2"))
    same_row = F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2"))
    marked = materialise(marked.join(own, same_row, "left_anti"), "marked")
    release(suffixes)
    texts = frame.join(marked.select(F.col("id").alias("id2"), F.col("th").alias("th2"), "at"), same_row)
    contexts = materialise(_contexts(texts.select("id", "th", "text", "at"), min_words, gram), "contexts", batch=TEXTS)
    release(marked)
    matches = materialise(_matches(contexts, min_words, gram), "matches")
    release(contexts)
    # Suffixes at the ends of sorted parts: those with the same words are one before their windows are compared.
    cut = matches.where("span is not null").select("span", F.col("stop").alias("near"), "wins", "places")
    alike = materialise(cut.groupBy("span").agg(F.min(F.array_min("places")).alias("lo"), F.max(F.array_max("places")).alias("hi"), F.first("near").alias("near"), F.first("wins").alias("wins")), "cut-spans")
    each = alike.select("span", "lo", "hi", "near", F.posexplode("wins").alias("k", "win"))
    at = lambda end: F.struct(F.col(f"{end}.id").alias("id"), F.col(f"{end}.th").alias("th"), (F.col(f"{end}.pos") - F.col("near") - F.col("k")).alias("start"))
    each = each.select("span", "k", "win", at("lo").alias("lo"), at("hi").alias("hi"))
    known = materialise(each.groupBy("win").agg(F.min("lo").alias("least"), F.max("hi").alias("greatest")).where("least <> greatest").select("win", "least"), "cut-windows")
    firsts = materialise(each.join(known, "win").groupBy("span").agg(F.collect_list(F.struct("k", "least")).alias("firsts")), "cut-firsts")

    def match(f: Column) -> Column:
        start = F.col("pos") - F.col("near") - f.k
        own = F.struct(F.col("id").alias("id"), F.col("th").alias("th"), start.alias("start"))
        return F.struct(start.alias("start"), (start + min_words).alias("stop"), f.least.id.alias("first"), (f.least != own).alias("again"))

    met = cut.drop("wins").join(firsts, "span").select("near", "firsts", F.inline("places"))
    joined = met.select("id", "th", F.transform("firsts", match).alias("rows"))
    inside = matches.where("span is null").select("id", "th", F.array(F.struct("start", "stop", "first", "again")).alias("rows"))
    # Windows of a text with copies are repeated, though only one copy's windows are here.
    gathered = inside.unionByName(joined).groupBy("id", "th").agg(F.flatten(F.collect_list("rows")).alias("rows"))
    whole = copies.select("id", "th", F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("stop"), F.lit(True).alias("redundant"), F.array_compact(F.array("least")).alias("first_ids"))).alias("spans"))
    kept = several.select(F.col("least").alias("id"), "th", F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("stop"), F.lit(False).alias("redundant"), F.array_compact(F.array("least")).alias("first_ids"))).alias("spans"))
    spans = _spans(gathered, min_words).unionByName(kept).groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return spans.unionByName(whole)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """``docs`` without the redundant passages, columns unchanged. A text that loses words keeps the rest of its
    characters as they were; a row none of whose words is left goes; rows without redundant passages stay as they are."""
    spans = repeats(docs, id_col, text_col, min_words, gram)
    cuts = spans.select(F.col("id").alias("id2"), F.col("th").alias("th2"), F.filter("spans", lambda s: s.redundant).alias("cuts")).where(F.size("cuts") > 0)
    text = F.col(text_col).cast("string")
    packed = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_key(text).alias("th"))
    joined = packed.join(materialise(cuts, "cuts"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("th") == F.col("th2")), "left")

    # Rows stay in the JVM; Python gets the texts that lose words alone. Not evaluated again for the filter below.
    def rest(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        return pa.array([without(t.as_py(), c.as_py()) if c.is_valid else None for t, c in zip(texts, cuts, strict=True)], pa.string())

    left = F.arrow_udf(rest, "string").asNondeterministic()
    cut = F.when(F.col("cuts").isNotNull(), F.col("row").getField(text_col).cast("string"))
    done = joined.select("row", left(cut, F.transform("cuts", lambda s: F.array(s.start, s.stop))).alias("left"))
    kept = done.where("left is null or left <> ''")
    columns = []
    for field in docs.schema.fields:
        own = F.col("row").getField(field.name)
        if field.name == text_col:
            own = F.coalesce(F.col("left"), own)
        elif field.name == "n_chars":
            own = F.when(F.col("left").isNull(), own).otherwise(F.length("left").cast(field.dataType))
        columns.append(own.alias(field.name))
    return kept.select(*columns)


def without(text: str | None, cuts: list[list[int]]) -> str:
    """``text`` without the words of the spans ``cuts``, or '' if no word is left."""
    data = (text or "").encode()
    drop: set[int] = set()
    for start, stop in cuts:
        drop.update(range(start, stop))
    out, at = [], 0
    for i, word in enumerate(data.split()):
        begin = data.find(word, at)
        if i not in drop:
            out.append(data[at:begin] if out else b"")
            out.append(word)
        at = begin + len(word)
    return b"".join(out).decode(errors="replace") if out else ""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per repeated passage of a document; documents without any are not listed."""
    found = repeats(table(spark, sf_dir, "documents")).select("id", F.explode("spans").alias("s"))
    return found.select(F.col("id").alias("doc_id"), F.col("s.start").alias("start_word"), F.col("s.stop").alias("stop_word"), F.col("s.redundant").alias("redundant"), F.array_min("s.first_ids").alias("first_doc_id"), F.size("s.first_ids").cast("long").alias("n_first"))


QUERIES = {"op4_suffix_dedup": op4_suffix_dedup}
# Every window of 50 words in full, for unique ids.
SQL = {
    "op4_suffix_dedup": r"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT text, min(doc_id) AS least FROM d WHERE len(w) >= 50 GROUP BY text HAVING count(DISTINCT doc_id) > 1),
whole AS (SELECT doc_id, 0 AS a, len(w) AS z, doc_id <> least AS redundant, least FROM d JOIN c USING (text)),
own AS (SELECT doc_id, w FROM d WHERE doc_id NOT IN (SELECT doc_id FROM whole WHERE redundant)),
win AS (SELECT doc_id, s - 1 AS pos, md5(array_to_string(w[s:s + 49], ' ')) AS win FROM own, unnest(range(1, len(w) - 48)) t(s)),
g AS (SELECT win, min((doc_id, pos)) AS first FROM win GROUP BY win HAVING count(*) > 1),
r AS (SELECT doc_id, pos, first[1] AS f, first <> (doc_id, pos) AS redundant FROM win JOIN g USING (win)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, redundant ORDER BY pos) AS island FROM r),
spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS z, redundant, min(f) AS least, count(DISTINCT f) AS n FROM i GROUP BY doc_id, redundant, island)
SELECT doc_id, CAST(a AS INTEGER) AS start_word, CAST(z AS INTEGER) AS stop_word, redundant, least AS first_doc_id, n AS n_first FROM spans
UNION ALL SELECT doc_id, 0, CAST(z AS INTEGER), redundant, least, 1::BIGINT FROM whole
""",
}
