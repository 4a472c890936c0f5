"""Nearest neighbours by cosine from randomly rotated one-bit codes.

A unit vector is turned by a fixed random rotation and kept as one bit per dimension, with one correction scalar: the inner
product a of the vector with its code, the unit vector of the signs. For a rotated query q, <code, q> / a estimates the
cosine, with an error that stays below ``ERROR_WIDTH * sqrt(1 / a^2 - 1) / sqrt(d - 1)`` save with a vanishing chance. Within
a block the vectors of best estimate are measured exactly, and then only those whose upper bound reaches the k-th of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitloom.llm.common import materialise, table

K = 5
ERROR_WIDTH = 3.0
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 512


def rotation(dimension: int, seed: int = 12) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, dimension)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits and correction scalars of finite nonzero vectors."""
    unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    turned = unit.astype(np.float32) @ turn
    return np.packbits(turned > 0, axis=1), (np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of paired rows in double precision, terms added from the first component to the last."""
    dot, na, nb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        x, y = a[:, d], b[:, d]
        dot += x * y
        na += x * x
        nb += y * y
    return dot / (np.sqrt(na) * np.sqrt(nb))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def nearest_in_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, corrections: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and cosine of the ``k`` best in a block for each query; a query's own id takes no part."""
    d = queries.shape[1]
    unit, whole = _unit(queries), _unit(vectors)
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    estimate = (unit.astype(np.float32) @ turn) @ signs.T / (np.float32(np.sqrt(d)) * corrections)
    error = (ERROR_WIDTH * np.sqrt(np.maximum(1 / corrections.astype(float) ** 2 - 1, 0)) / np.sqrt(max(1, d - 1)) + 1e-5).astype(np.float32)
    own = query_ids[:, None] == ids[None, :]
    estimate[own] = -np.inf
    # The vectors of best estimate are measured first: what cannot reach the k-th of them is out by its bound.
    least = np.full(len(queries), -np.inf)
    if len(ids) > k:
        first = np.argpartition(estimate, len(ids) - k, axis=1)[:, len(ids) - k :]
        measured = np.einsum("qd,qkd->qk", unit, whole[first])
        measured[np.take_along_axis(own, first, axis=1)] = -np.inf
        least = measured.min(axis=1) - 1e-9
    q, v = np.nonzero((estimate + error >= least[:, None].astype(np.float32) - np.float32(1e-6)) & ~own)
    near = np.concatenate([np.einsum("nd,nd->n", unit[q[i : i + 100_000]], whole[v[i : i + 100_000]]) for i in range(0, len(q), 100_000)] or [np.zeros(0)])
    close = near >= least[q]
    q, v = q[close], v[close]
    score = np.concatenate([cosines(queries[q[i : i + 200_000]], vectors[v[i : i + 200_000]]) for i in range(0, len(q), 200_000)] or [np.zeros(0)])
    order = np.lexsort((ids[v], -score, q))
    q, v, score = q[order], v[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
    best = rank < k
    return query_ids[q[best]], ids[v[best]], score[best]


def _distinct(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Of rows of equal id and vector one, and of equal vectors those of the ``k + 1`` smallest ids: no other can be among
    the ``k`` nearest of any query."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    _, same = np.unique(raw, return_inverse=True)
    order = np.lexsort((ids, same))
    s, i = same[order], ids[order]
    fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (i[1:] != i[:-1])))
    order, s = order[fresh], s[fresh]
    rank = np.arange(len(s)) - np.searchsorted(s, s, side="left")
    return np.sort(order[rank <= k])


def _packed(rows: DataFrame, turn: np.ndarray, size: int, k: int | None) -> DataFrame:
    """Blocks of up to ``size`` vectors: ids, vectors as doubles, codes and corrections, each as bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
            if k is not None:
                chosen = _distinct(ids, vectors, k)
                ids, vectors = ids[chosen], vectors[chosen]
            codes, corrections = encode(vectors, turn)
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, codes, corrections)], ["ids", "vectors", "codes", "corrections"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            for at in range(0, len(ids), size):
                held.append((ids[at : at + size], vectors[at : at + size]))
                n += len(held[-1][0])
                if n >= size:
                    yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield block(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.mapInArrow(of, "ids binary, vectors binary, codes binary, corrections binary")


def usable(vector: Column) -> Column:
    """Neither null nor zero, and no component null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the ``k`` nearest of ``vectors`` for each of ``queries`` (same columns).

    Every usable vector is encoded; a query meets all blocks. Null, zero or non-finite vectors, null ids and vectors of
    another length than most take no part. Rows of one id are one vector if equal, and never neighbours of each other;
    ties go to the smaller id; with fewer than ``k`` candidates all are returned; an empty table gives no rows. Many copies
    of one vector cost no more than ``k + 1`` of them in each block.
    """

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        return df.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    good = clean(vectors)
    length = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    shape = "query_id long, vec_id long, score double"
    if length is None:
        return vectors.sparkSession.createDataFrame([], shape).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    d = length["n"]
    turn = rotation(d)
    blocks = materialise(_packed(good.where(F.size("v") == d), turn, BLOCK_VECTORS, k), "neighbour-blocks")
    asked = _packed(clean(queries).where(F.size("v") == d).dropDuplicates(["id"]), turn, BLOCK_QUERIES, None)
    asked = materialise(asked.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "neighbour-queries")
    # A stated set of queries against all rows, part by part of both files: neither side is broadcast, which the driver would
    # have to hold, nor copied for each part of the other.
    met = blocks.hint("shuffle_replicate_nl").crossJoin(asked)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_vectors, ids, own, codes, corrections in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                numbers = np.frombuffer(ids, dtype=np.int64)
                found = nearest_in_block(
                    np.frombuffer(q_vectors).reshape(-1, d), np.frombuffer(q_ids, dtype=np.int64), np.frombuffer(own).reshape(-1, d), numbers,
                    np.frombuffer(codes, dtype=np.uint8).reshape(len(numbers), -1), np.frombuffer(corrections, dtype=np.float32), turn, k,
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    pairs = met.select("q_ids", "q_vectors", "ids", "vectors", "codes", "corrections").mapInArrow(of, shape)
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"))


_SUM = "list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), lambda x, y: x + y)"

SQL = {
    "op2_neighbours": f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt({_SUM.format(a="v", b="v")}) AS n FROM e),
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_SUM.format(a="q.v", b="c.v")} / (q.n * c.n) AS score FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
""",
}
QUERIES = {"op2_neighbours": op2_neighbours}
