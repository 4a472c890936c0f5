"""Toxicity by compression distance: windows that a dictionary of toxic text shortens more than one of ordinary text.

zstandard trains one dictionary on windows of toxic texts and one on windows of ordinary ones. Most of what either holds is
common to both classes and only adds noise to short windows, so a trained dictionary is judged on labelled texts it has not
seen: words that shorten windows in clearly more texts of their own class stay. Texts that these leave alone train the next
dictionary, so that words of rarer languages come up too. The words follow a body common to both sides, trained on ordinary
windows, so that ordinary text compresses alike under either. The difference in compressed length, window by window, is
near 0 for ordinary text. Counts of windows above three differences, their shares, the largest difference and the number of
windows go into a logistic calibration fitted on labelled texts that had no part in the dictionaries.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitloom.llm.common import materialise, release, table

#: The classifier is fitted on the labelled training rows with the smallest hashes of doc_id, so many at most, and so many bytes
#: of text.
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 64 << 20
BODY_BYTES = 32_768
TAIL_BYTES = 512
#: Windows of 64 bytes, 48 apart: each phrase of up to 16 bytes lies whole in one of them.
WINDOW, STRIDE = 64, 48
DIFFERENCES = (3, 5, 7)
#: A part of a trained dictionary is telling if so many standard errors part the shares of texts that it shortens.
LEAST_CONTRAST = 3.0
#: zstandard does not look up matches that begin in the last eight bytes of a dictionary: something else has to stand there.
FILL = b" " * 8
LEAST_GAIN = 3
#: Trained dictionaries before the choice, and the segments they are made of.
DRAFT_BYTES, SEGMENT = 4096, 24
#: Drafts of a class, one after the other: each is trained on the texts that the earlier ones' telling parts do not shorten.
DRAFTS = 4
#: Windows of each class and third by which dictionaries are trained and judged, at most.
SAMPLE_WINDOWS = 20_000
SLAB = 65_536
BATCH_BYTES = 4 << 20


def _normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def _windows(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as one buffer, (offset, length) of every window, and where each text's windows begin."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(length) - length
    count = np.where(length <= WINDOW, 1, -(-(length - WINDOW) // STRIDE) + 1)
    first = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(begin, count) + (np.arange(first[-1]) - np.repeat(first[:-1], count)) * STRIDE
    size = np.minimum(WINDOW, np.repeat(begin + length, count) - at)
    return b"".join(texts), np.stack([at, size], axis=1).astype(np.uint64), first


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


def _lengths(compressor: zstandard.ZstdCompressor, buffer: bytes, windows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(windows), dtype=np.int32)
    full = np.nonzero(windows[:, 1])[0]
    for k in range(0, len(full), SLAB):
        some = full[k : k + SLAB]
        packed = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(buffer, windows[some].tobytes()))
        out[some] = [len(packed[i]) for i in range(len(packed))]
    return out


@dataclass
class ToxicityModel:
    """Dictionaries and calibration. Without labels of both kinds there are no dictionaries and every text gets ``prior``."""

    prior: float
    toxic: bytes = b""
    ordinary: bytes = b""
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def features(self, texts: list[bytes]) -> np.ndarray:
        buffer, windows, first = _windows(texts)
        gain = _lengths(_compressor(self.ordinary), buffer, windows) - _lengths(_compressor(self.toxic), buffer, windows)
        count = np.diff(first)
        found = []
        for least in DIFFERENCES:
            above = np.add.reduceat((gain >= least).astype(float), first[:-1])
            found += [np.log1p(above), above / count]
        return np.stack([*found, np.maximum.reduceat(gain, first[:-1]), np.log(count)], axis=1).astype(float)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.prior)
        out, batch, size = [], [], 0
        for text in texts:
            batch.append(_normal(text))
            size += len(batch[-1])
            if size > BATCH_BYTES:
                out.append(self._probability(self.features(batch)))
                batch, size = [], 0
        if batch:
            out.append(self._probability(self.features(batch)))
        return np.concatenate(out)

    def _probability(self, features: np.ndarray) -> np.ndarray:
        logit = np.column_stack([np.ones(len(features)), (features - self.mean) / self.spread]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _trained(windows: list[bytes]) -> bytes:
    """What zstandard picks from the windows of one class."""
    try:
        return zstandard.train_dictionary(DRAFT_BYTES, windows, k=SEGMENT, d=8, level=3).as_bytes()[-DRAFT_BYTES:]
    except zstandard.ZstdError:  # too little text to train on: the windows themselves
        return b"".join(windows)[-DRAFT_BYTES:]


class _Sample:
    """Windows of texts of one class, with their compressed lengths under the common body."""

    def __init__(self, texts: list[bytes], body: bytes) -> None:
        chosen, total = [], 0
        for text in texts:  # whole texts, so that a text's windows stand for it
            count = max(1, -(-(len(text) - WINDOW) // STRIDE) + 1)
            if count <= SAMPLE_WINDOWS // 8 and total + count <= SAMPLE_WINDOWS:
                chosen.append(text)
                total += count
        self.texts = len(chosen)
        self.buffer, self.places, first = _windows(chosen)
        self.of = np.repeat(np.arange(len(chosen)), np.diff(first))
        self.body = body
        self.base = _lengths(_compressor(body), self.buffer, self.places)

    def windows(self, of: np.ndarray | None = None) -> list[bytes]:
        """All windows, or those of the texts numbered ``of``."""
        places = self.places if of is None else self.places[np.isin(self.of, of)]
        return [self.buffer[a : a + n] for a, n in places.astype(np.int64).tolist()]

    def untouched(self, content: bytes) -> np.ndarray:
        """The texts none of whose windows ``content`` shortens."""
        return np.setdiff1d(np.arange(self.texts), self.of[self.shortened(content)])

    def gain(self, content: bytes, at: np.ndarray) -> np.ndarray:
        return self.base[at] - _lengths(_compressor(self.body + content + FILL), self.buffer, self.places[at])

    def shortened(self, content: bytes) -> np.ndarray:
        return np.nonzero(self.gain(content, np.arange(len(self.base))) >= LEAST_GAIN)[0]


def _whole_words(piece: bytes, text: bytes) -> list[bytes]:
    """The words in ``piece``; those cut at its ends are completed as they most often go on in ``text``."""
    for left in (True, False):
        for _ in range(16):
            edge = piece[:1] if left else piece[-1:]
            if edge in (b" ", b""):
                break
            places = (m.start() for m in re.finditer(re.escape(piece), text))
            beside = Counter(text[i - 1 : i] if left else text[i + len(piece) : i + len(piece) + 1] for i in places)
            add = beside.most_common(1)[0][0] if beside else b""
            piece = add + piece if left else piece + add
            if not add:
                break
    return piece.split()


def _telling(draft: bytes, own: _Sample, other: _Sample) -> list[tuple[float, bytes]]:
    """The words of a trained dictionary that shorten windows in more texts of its own class than of the other one, by
    ``LEAST_CONTRAST`` standard errors of the log ratio; neither sample was trained on. Segments that tell half as much
    name the words; one after the other the best word is taken, and the windows it shortens are set aside."""
    mine, theirs = own.shortened(draft), other.shortened(draft)
    if not len(mine):
        return []

    def marks(pieces: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
        return np.stack([own.gain(p, mine) >= least for p in pieces]), np.stack([other.gain(p, theirs) >= least for p in pieces])

    def contrast(hit: np.ndarray, miss: np.ndarray) -> np.ndarray:
        def texts(found: np.ndarray, of: np.ndarray) -> np.ndarray:
            seen = np.zeros((len(found), of.max() + 1 if len(of) else 0), dtype=bool)
            which, window = np.nonzero(found)
            seen[which, of[window]] = True
            return seen.sum(axis=1) + 0.5

        a, b = texts(hit, own.of[mine]), texts(miss, other.of[theirs])
        return np.log(a / (own.texts + 1) * (other.texts + 1) / b) / np.sqrt(1 / a + 1 / b)

    segments = [draft[i : i + SEGMENT] for i in range(0, max(1, len(draft) - SEGMENT + 1), SEGMENT // 2)]
    text = b" ".join(own.windows())
    named = [s for s, c in zip(segments, contrast(*marks(segments, LEAST_GAIN)), strict=True) if c >= LEAST_CONTRAST / 2]
    words = sorted({w for s in named for w in _whole_words(s, text)})
    found: list[tuple[float, bytes]] = []
    if not words:
        return found
    # A word has less around it than a segment, so a byte less is asked of it.
    hit, miss = marks([b" " + w + b" " for w in words], LEAST_GAIN - 1)
    while len(found) < len(words):
        told = contrast(hit, miss)
        best = int(told.argmax())
        if told[best] < LEAST_CONTRAST:
            break
        found.append((float(told[best]), words[best]))
        hit &= ~hit[best]
        miss &= ~miss[best]
    return found


def _drafted(train: _Sample, own: _Sample, other: _Sample) -> list[tuple[float, bytes]]:
    """The telling parts of dictionaries trained on ``train``. The most frequent words of a class fill the first dictionary; what is
    telling in fewer texts, such as those of a rarer language, comes up in one trained on the texts left over."""
    found: list[tuple[float, bytes]] = []
    left = np.arange(train.texts)
    for _ in range(DRAFTS):
        more = _telling(_trained(train.windows(left)), own, other)
        fresh = [f for f in more if f[1] not in {run for _, run in found}]
        found += fresh
        rest = train.untouched(_ending(found, TAIL_BYTES)) if fresh else left
        if not len(rest) or len(rest) == len(left):
            break
        left = rest
    return found


def _ending(found: list[tuple[float, bytes]], room: int) -> bytes:
    """The most telling last, where matches cost least."""
    picked: list[bytes] = []
    for _, run in sorted(found, reverse=True):
        if run not in picked and sum(map(len, picked)) + len(picked) + len(run) + 2 <= room:
            picked.append(run)
    return b" " + b" ".join(reversed(picked)) + b" "


def _sketch(words: list[bytes]) -> set[tuple[int, int]]:
    """Least hashes of five-word shingles under four orders; texts of which most shingles agree share one or more."""
    shingles = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    hashes = np.array([xxhash.xxh64_intdigest(s) for s in shingles], dtype=np.uint64)
    return {(k, int((hashes * np.uint64(odd)).min())) for k, odd in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))}


def fit(texts: list[str | None], toxic: list[int]) -> ToxicityModel:
    """Two thirds of the rows train and choose the dictionaries, each third judging what the other trained; the last third
    calibrates. The order of rows should be random."""
    normal = [_normal(t) for t in texts]
    label = np.array(toxic, dtype=int)
    prior = float(label.mean()) if len(label) else 0.0
    third = np.arange(len(label)) % 3
    if any(not ((label == x) & (third == part)).any() for x in (0, 1) for part in range(3)):
        return ToxicityModel(prior)
    seen: set[tuple[int, int]] = set()
    own: dict[tuple[int, int], list[bytes]] = {(x, part): [] for x in (0, 1) for part in (0, 1)}
    for text, x, part in zip(normal, label.tolist(), third.tolist(), strict=True):
        if part < 2:
            sketch = _sketch(text.split())
            if not sketch & seen:  # near copies of a text count once
                own[x, part].append(text)
            seen |= sketch
    buffer, windows, _ = _windows(own[0, 0] + own[0, 1] or [b""])
    chosen = random.Random(0).sample(range(len(windows)), min(len(windows), 60_000))
    samples = [buffer[a : a + n] for a, n in windows[sorted(chosen)].astype(np.int64).tolist()]
    try:
        body = zstandard.train_dictionary(BODY_BYTES, samples, level=3).as_bytes()[-BODY_BYTES:]
    except zstandard.ZstdError:
        body = b"".join(samples)[-BODY_BYTES:]
    sampled = {key: _Sample(found, body) for key, found in own.items() if found}
    ends = []
    for x in (1, 0):
        found = [f for part in (0, 1) if {(x, part), (x, 1 - part), (1 - x, 1 - part)} <= sampled.keys() for f in _drafted(sampled[x, part], sampled[x, 1 - part], sampled[1 - x, 1 - part])]
        ends.append(_ending(found, TAIL_BYTES))
    width = max(map(len, ends))
    for i, x in enumerate((1, 0)):  # both as long: the rest is the end of what the class trained
        spare = width - len(ends[i])
        first = sampled.get((x, 0)) or sampled.get((x, 1))
        draft = _trained(first.windows()) if first and spare else b""
        ends[i] = (draft[len(draft) - spare :] if spare else b"").rjust(spare) + ends[i]
    model = ToxicityModel(prior, body + ends[0] + FILL, body + ends[1] + FILL)
    held = np.nonzero(third == 2)[0]
    features = np.concatenate([model.features([normal[i] for i in held[k : k + 500]]) for k in range(0, len(held), 500)])
    model.mean, model.spread = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(held)), (features - model.mean) / model.spread])
    weights, y = np.zeros(x.shape[1]), label[held]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
        weights -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(weights)), x.T @ (p - y) + 0.05 * weights)
    model.weights = weights
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> ToxicityModel:
    """Fit on the labelled documents with the smallest hashes of their id, at most ``rows`` of them and ``size`` bytes of text.

    Null ids and labels are not used; of several labels of an id the greatest counts, of several texts the one with the
    least hash; a null text is an empty one. Without labels, or with too few of either class, every text gets their mean.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.select("id", "y").orderBy(F.xxhash64("id"), "id").limit(rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    picked = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    picked = materialise(picked.groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxicity-sample")
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("id"), "id"))
    fits = picked.select("id", so_far.alias("bytes")).where(F.col("bytes") <= size).select("id")  # of ``rows`` sizes
    sample = picked.join(F.broadcast(fits), "id").select(F.xxhash64("id").alias("h"), "id", "text", "y").toPandas().sort_values(["h", "id"], kind="stable")
    release(picked)
    return fit(sample["text"].tolist(), (sample["y"] > 0).astype(int).tolist())


def scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``, its columns packed in ``row``, with its ``score``: the chance that label 1 is given.

    Null and empty texts are scored as one empty window; repeated rows each get a score; an empty table gives no rows.
    """
    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("t"))
    row_type = packed.schema["row"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["row", "score"])

    return packed.mapInArrow(of, f"row {row_type}, score double")


def _remainder(column: str, n: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(_remainder("doc_id", 5) != 0)
    found = scores(docs, train(docs, labels))
    return found.select("row.doc_id", "score").select("doc_id", (_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` scored below ``threshold``, with their columns."""
    return scores(docs, train(docs, labels)).where(F.col("score") < threshold).select("row.*")


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
