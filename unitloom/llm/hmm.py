"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by the scaled forward recursion.

Words fall into classes by a hash. Each state emits a class, the end of a text or the unknown word, smoothed towards the
corpus's own shares; within its class a word has its share of the corpus counts, so all words of all states have
probabilities that add up to 1. The unknown word has the share of words seen once (Good-Turing), alike in all states. Counts of all words are kept, however many there are, in tables that are joined, not
broadcast; what every task receives is the states' table over the fixed number of classes.

The texts are packed once into chunks of bounded size: word numbers local to the chunk, and the chunk's words. A chunk's
words meet the corpus counts in a join by word, so rows are shuffled per chunk and word, not per token.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitloom.llm.common import materialise, table

STATES = 4
CLASSES = 4096
ROUNDS = 3
ADD = 0.1
#: Weight, in tokens, of the corpus's shares of classes in each state.
PRIOR = 500.0
CHUNK_TOKENS = 4_000_000
CHUNK_DOCS = 20_000
SEGMENT = 64
#: Scale after so many words, far above where doubles end.
RESCALE = 8
#: Two more classes follow the hashed ones.
END, UNKNOWN = CLASSES, CLASSES + 1
END_WORD = b"\n"  # no word holds white space


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def class_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7) % CLASSES


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x classes, of shares within the classes' corpus shares


def initial(share: np.ndarray, states: int = STATES) -> Model:
    """Every state starts from the corpus's shares, shaken by a fixed random factor for each class."""
    rng = np.random.default_rng(20)
    emit = share * rng.uniform(0.3, 1.7, (states, len(share)))
    emit[:, UNKNOWN] = 0
    emit *= (1 - share[UNKNOWN]) / np.maximum(emit.sum(axis=1, keepdims=True), 1e-300)
    emit[:, UNKNOWN] = share[UNKNOWN]
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit)


def _segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into segments: first token, length, text and number within the text of each."""
    count = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(lengths) - lengths, count) + number * SEGMENT
    return begin, np.minimum(SEGMENT, np.repeat(lengths, count) - number * SEGMENT), text, number


def forward(model: Model, classes: np.ndarray, lengths: np.ndarray, counts: bool = False):
    """Natural logarithm of each text's likelihood of classes; with ``counts`` also the expected counts of Baum-Welch.

    All segments advance together: first each one's product of transition and emission matrices, then the chain of
    segments of each text, then, for the counts, the recursions within the segments from their exact borders.
    """
    k = len(model.start)
    begin, size, text, number = _segments(lengths)
    m = len(begin)
    emit = np.ascontiguousarray(model.emit.T)
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(SEGMENT), side="left")  # how many segments are longer than t
    begin_o = begin[order]
    first_o = number[order] == 0
    product = np.broadcast_to(np.eye(k), (m, k, k)).copy()
    scale = np.zeros(m)
    for t in range(SEGMENT):
        n = alive[t]
        if not n:
            break
        part = product[:n]
        # The first word of a text is reached without a move.
        moved = np.where(first_o[:n, None, None], part, model.move) if t == 0 else (part.reshape(-1, k) @ model.move).reshape(n, k, k)
        np.multiply(moved, emit[classes[begin_o[:n] + t]][:, None, :], out=part)
        if t % RESCALE == RESCALE - 1:
            total = part.reshape(n, -1).max(axis=1)
            part /= total[:, None, None]
            scale[:n] += np.log(total)
    back = np.empty(m, dtype=np.int64)
    back[order] = np.arange(m)
    product, scale = product[back], scale[back]
    # Chain the segments of each text, all texts at once.
    n_text = len(lengths)
    entering = np.empty((m, k))
    alpha = np.broadcast_to(model.start, (n_text, k)).copy()
    log = np.zeros(n_text)
    by_number = np.argsort(number, kind="stable")
    cuts = np.searchsorted(number[by_number], np.arange(number.max() + 2 if m else 1))
    for j in range(len(cuts) - 1):
        at = by_number[cuts[j] : cuts[j + 1]]
        own = text[at]
        entering[at] = alpha[own]
        new = np.einsum("nk,nkl->nl", alpha[own], product[at])
        total = new.sum(axis=1)
        alpha[own] = new / total[:, None]
        log[own] += np.log(total) + scale[at]
    if not counts:
        return log
    leaving = np.ones((m, k))
    beta = np.ones((n_text, k))
    for j in range(len(cuts) - 2, -1, -1):
        at = by_number[cuts[j] : cuts[j + 1]]
        own = text[at]
        leaving[at] = beta[own]
        new = np.einsum("nkl,nl->nk", product[at], beta[own])
        beta[own] = new / new.sum(axis=1, keepdims=True)
    emitted = np.zeros((k, model.emit.shape[1]))
    moves, starts = np.zeros((k, k)), np.zeros(k)
    for at in range(0, m, 8192):  # bounded working set
        idx = order[at : at + 8192]
        length, first, entered = size[idx], number[idx] == 0, entering[idx]
        live = np.searchsorted(-length, -np.arange(SEGMENT), side="left")
        seen, ahead, where = [], [], []
        for t in range(SEGMENT):
            n = live[t]
            if not n:
                break
            where.append(classes[begin[idx[:n]] + t])
            b = emit[where[t]]
            now = np.where(first[:n, None], entered[:n], entered[:n] @ model.move) * b if t == 0 else (ahead[t - 1][:n] @ model.move) * b
            if t % RESCALE == 0:
                now /= now.sum(axis=1, keepdims=True)
            seen.append(b)
            ahead.append(now)
        late = leaving[idx].copy()
        for t in range(len(ahead) - 1, -1, -1):
            n = live[t]
            if t % RESCALE == 0:
                late[:n] /= late[:n].sum(axis=1, keepdims=True)
            gamma = ahead[t] * late[:n]
            gamma /= gamma.sum(axis=1, keepdims=True)
            for s in range(k):
                emitted[s] += np.bincount(where[t], gamma[:, s], minlength=emitted.shape[1])
            right = seen[t] * late[:n]
            new = right @ model.move.T
            left = ahead[t - 1][:n] if t else entered[:n]
            weight = 1 / np.einsum("nk,nk->n", left, new)
            if t == 0:
                starts += gamma[first[:n]].sum(axis=0)
                weight = np.where(first[:n], 0.0, weight)
            moves += (left * weight[:, None]).T @ right * model.move
            late[:n] = new
    return log, starts, moves, emitted


def _pack(docs: DataFrame) -> DataFrame:
    """Chunks of texts (``kind`` 0) and the words of each chunk (``kind`` 1)."""
    shape = "kind int, chunk string, row_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, classes binary, word binary, class int, number int, trained long"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, held, sizes, parts, trained_words = [], [], [], [], []
        number: dict[bytes, int] = {}
        total = 0

        def flush():
            nonlocal ids, held, sizes, parts, number, total, made
            chunk = f"{part}-{made}"
            made += 1
            tokens = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
            learnt = np.repeat(~np.array(held, dtype=bool), sizes)
            trained = np.bincount(tokens[learnt], minlength=len(number))
            n = len(number)
            key = list(number)
            classes = np.fromiter((END if w == END_WORD else class_of(w) for w in key), np.int32, n)
            one = pa.RecordBatch.from_pydict({"kind": pa.array([0], pa.int32()), "chunk": [chunk], "row_ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())), "sizes": pa.array([sizes], pa.list_(pa.int32())), "tokens": pa.array([tokens.tobytes()], pa.binary()), "classes": pa.array([classes.tobytes()], pa.binary()), "word": pa.array([None], pa.binary()), "class": pa.array([None], pa.int32()), "number": pa.array([None], pa.int32()), "trained": pa.array([None], pa.int64())})
            two = pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(n, dtype=np.int32)), "chunk": pa.array([chunk] * n), "row_ids": pa.nulls(n, pa.list_(pa.int64())), "held": pa.nulls(n, pa.list_(pa.bool_())), "sizes": pa.nulls(n, pa.list_(pa.int32())), "tokens": pa.nulls(n, pa.binary()), "classes": pa.nulls(n, pa.binary()), "word": pa.array(key, pa.binary()), "class": pa.array(classes), "number": pa.array(np.arange(n, dtype=np.int32)), "trained": pa.array(trained.astype(np.int64))})
            ids, held, sizes, parts, number, total = [], [], [], [], {}, 0
            yield one
            for k in range(0, n, 50_000):
                yield two.slice(k, 50_000)

        for batch in batches:
            for row_id, is_held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = words(text.as_py())
                own.append(END_WORD)
                parts.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int32, len(own)))
                ids.append(row_id)
                held.append(is_held)
                sizes.append(len(own))
                total += len(own)
                if total >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.mapInArrow(of, shape)


@dataclass
class Corpus:
    """What scoring needs: chunks of texts, and the corpus count of each word of each chunk."""

    chunks: DataFrame  # chunk, row_ids, held, sizes, tokens, classes
    known: DataFrame  # chunk, numbers, counts
    total: int
    distinct: int
    mass: np.ndarray  # of each class: counts of its words, each plus ADD
    share: np.ndarray  # of each class and the unknown word; they add up to 1


def gather(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> Corpus:
    """Counts over all texts for which ``held`` is false."""
    packed = materialise(_pack(docs.select(F.col(id_col).cast("long"), held.alias("held"), F.col(text_col).cast("string"))), "hmm-packed", "kind")
    local = packed.where("kind = 1").select("chunk", "word", "class", "number", "trained")
    # A word has one row for each chunk that holds it; all its rows meet once, and get its count.
    meeting = Window.partitionBy("word")
    counted = local.select("chunk", "number", "class", F.sum("trained").over(meeting).alias("c"), (F.row_number().over(meeting.orderBy("chunk")) == 1).alias("leads"))
    counted = materialise(counted, "hmm-counts")
    by_class = counted.where("leads and c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).collect()  # CLASSES + 1 rows at most
    tokens, kinds = np.zeros(CLASSES + 2), np.zeros(CLASSES + 2)
    for r in by_class:
        tokens[r["class"]], kinds[r["class"]] = r["c"], r["v"]
    total, distinct = int(tokens.sum()), int(kinds.sum())
    mass = tokens + ADD * kinds
    share = mass.copy()
    unseen = (sum(r["once"] for r in by_class) + ADD) / (total + 2 * ADD + 1)
    share *= (1 - unseen) / max(share.sum(), 1e-300)
    share[UNKNOWN] = unseen if share.sum() else 1.0
    known = counted.groupBy("chunk").agg(F.collect_list(F.struct("number", "c")).alias("w")).select("chunk", F.col("w.number").alias("numbers"), F.col("w.c").alias("counts"))
    chunks = packed.where("kind = 0").select("chunk", "row_ids", "held", "sizes", "tokens", "classes")
    return Corpus(chunks, materialise(known, "hmm-known"), total, distinct, mass, share)


def _sorted(numbers: pa.Array, values: pa.Array, kind) -> np.ndarray:
    out = np.zeros(len(numbers), dtype=kind)
    out[numbers.to_numpy()] = values.to_numpy()
    return out


def train(corpus: Corpus, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts; each round sums the expected counts of every chunk."""
    model = initial(corpus.share, states)
    chunks = corpus.chunks.select("held", "sizes", "tokens", "classes")
    width = CLASSES + 2
    for _ in range(rounds if corpus.total else 0):

        def of(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((states, width))
            for batch in batches:
                for r in range(batch.num_rows):
                    sizes = batch.column(1)[r].values.to_numpy().astype(np.int64)
                    learnt = ~batch.column(0)[r].values.to_numpy(zero_copy_only=False)
                    classes = np.frombuffer(batch.column(3)[r].as_py(), dtype=np.int32)[np.frombuffer(batch.column(2)[r].as_py(), dtype=np.int32)]
                    if learnt.any():
                        _, s, m, e = forward(model, classes[np.repeat(learnt, sizes)], sizes[learnt], counts=True)
                        starts, moves, emitted = starts + s, moves + m, emitted + e
            flat = np.concatenate((starts, moves.ravel(), emitted.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["cell", "x"])

        cells = chunks.mapInArrow(of, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()  # states * (classes + states + 3)
        flat = np.zeros(states + states * states + states * width)
        for cell, x in cells:
            flat[cell] = x
        starts, moves, emitted = np.split(flat, [states, states + states * states])
        emitted = emitted.reshape(states, width) + PRIOR * corpus.share
        emitted[:, UNKNOWN] = 0
        emitted *= (1 - corpus.share[UNKNOWN]) / np.maximum(emitted.sum(axis=1, keepdims=True), 1e-300)
        emitted[:, UNKNOWN] = corpus.share[UNKNOWN]
        moves = moves.reshape(states, states) + 1.0
        model = Model((starts + 1) / (starts + 1).sum(), moves / moves.sum(axis=1, keepdims=True), emitted)
    return model


def score(corpus: Corpus, model: Model) -> DataFrame:
    """``id``, ``held``, ``n_tokens``, ``n_known``, ``base`` and ``score`` (logarithms to base 10) of every text."""
    floor = corpus.total + ADD * (corpus.distinct + 1)
    mass = np.maximum(corpus.mass, ADD)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                sizes = batch.column(2)[r].values.to_numpy().astype(np.int64)
                counts = _sorted(batch.column(5)[r].values, batch.column(6)[r].values, np.int64)
                classes = np.where(counts > 0, np.frombuffer(batch.column(4)[r].as_py(), dtype=np.int32), UNKNOWN)
                base = np.log((counts + ADD) / floor)
                within = np.where(counts > 0, np.log((counts + ADD) / mass[classes]), 0.0)  # of a word in its class
                tokens = np.frombuffer(batch.column(3)[r].as_py(), dtype=np.int32)
                first = np.cumsum(sizes) - sizes
                log = forward(model, classes[tokens], sizes) + np.add.reduceat(within[tokens], first)
                ten = math.log(10)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[r].values, batch.column(1)[r].values, pa.array(sizes), pa.array(np.add.reduceat((counts > 0)[tokens].astype(np.int64), first)), pa.array(np.add.reduceat(base[tokens], first) / ten), pa.array(log / ten)],
                    ["id", "held", "n_tokens", "n_known", "base", "score"],
                )

    joined = corpus.chunks.join(corpus.known, "chunk").select("row_ids", "held", "sizes", "tokens", "classes", "numbers", "counts")
    return joined.mapInArrow(of, "id long, held boolean, n_tokens long, n_known long, base double, score double")


def language_model_scores(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Scores of every row and the number of training tokens.

    A null or blank text is its end alone. Repeated rows and null ids keep their rows; an empty table gives no rows. If no
    row is for training, every word is unknown and the model keeps its first, corpus-free shape.
    """
    corpus = gather(docs, held, id_col, text_col)
    return score(corpus, train(corpus)), corpus.total


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    found, total = language_model_scores(table(spark, sf_dir, "documents"), held)
    return found.select(F.col("id").alias("doc_id"), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


QUERIES = {"op9_hmm": op9_hmm}
SQL: dict[str, str] = {}
