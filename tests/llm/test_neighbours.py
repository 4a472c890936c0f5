import math
import random

import numpy as np

from unitloom.llm import neighbours

SHAPE = "vec_id long, embedding array<float>, id long, score double, slot int"


def exact(rows, queries, k=5):
    def usable(v):
        return v is not None and None not in v and all(math.isfinite(x) for x in v) and any(v)

    good = {i: v for i, v in rows if i is not None and usable(v) and len(v) == 16}
    out = {}
    for q in queries:
        if q in good:
            a = np.array(good[q], dtype=np.float32).astype(float)
            scored = []
            for i, v in good.items():
                if i != q:
                    b = np.array(v, dtype=np.float32).astype(float)
                    scored.append((-neighbours.cosines(a[None], b[None])[0], i))
            out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def rows():
    rng = random.Random(2)
    out = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(300)]
    out += [(300 + i, out[7][1]) for i in range(40)]  # copies of one vector
    out += [(400, None), (401, [0.0] * 16), (402, [1.0] * 15 + [None]), (403, [float("nan")] * 16), (404, [float("inf")] + [1.0] * 15), (405, [1.0]), (None, [1.0] * 16), (406, [])]
    return out + [out[3], out[7]]


def test_nearest_equals_brute_force(spark):
    frame = spark.createDataFrame([(i, v, 1, 0.0, 2) for i, v in rows()], SHAPE)
    found = neighbours.nearest(frame, frame.where("vec_id % 50 = 0 or vec_id = 7")).orderBy("query_id", "rank").collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == exact(rows(), [0, 7, 50, 100, 150, 200, 250, 300, 400])


def test_fewer_candidates_and_empty_tables(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0, 2), (1, [1.0, 1.0], 1, 0.0, 2)], SHAPE)
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.nearest(two, two.where("vec_id = 0")).collect()] == [(0, 1, 1)]
    none = spark.createDataFrame([], SHAPE)
    assert neighbours.nearest(none, none).collect() == []
    assert neighbours.nearest(two, none).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 64))
    turn = neighbours.rotation(64)
    codes, a = neighbours.encode(x, turn)
    q = rng.standard_normal((20, 64))
    unit = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32) @ turn
    signs = np.unpackbits(codes, axis=1, count=64).astype(np.float32) * 2 - 1
    estimate = unit @ signs.T / (8 * a)
    true = q @ x.T / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    bound = neighbours.ERROR_WIDTH * np.sqrt(1 / a.astype(float) ** 2 - 1) / np.sqrt(63)
    assert (np.abs(estimate - true) <= bound).mean() > 0.995


def test_no_side_is_broadcast(spark):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 16)))], "vec_id long, embedding array<double>")
    found = neighbours.nearest(frame.repartition(5), frame.where("vec_id % 50 = 0"))
    assert found.count() == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" in plan
