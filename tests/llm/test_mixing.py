import random
from fractions import Fraction

import pytest

from tests.llm.fixtures import SHAPE, documents
from unitloom.llm import mixing


def brute(blocks, weights):
    """Slot by slot: of the released blocks of sources that are left, the one due first."""
    exact = [Fraction(str(w)) for w in weights]
    placed, slots, phases = [0] * len(blocks), [], []
    while any(p < n for p, n in zip(placed, blocks)):
        active = [i for i in range(len(blocks)) if placed[i] < blocks[i]]
        share = {i: exact[i] / sum(exact[j] for j in active) for i in active}
        start, begin = dict(enumerate(placed)), len(slots)
        while True:
            t = len(slots) - begin
            ready = []
            for i in active:
                k = placed[i] - start[i] + 1
                if (k - 1) / share[i] // 1 <= t:
                    ready.append((-(-k / share[i] // 1), i))
            due, i = min(ready)
            if placed[i] == blocks[i]:
                break
            assert due > t
            slots.append(i)
            placed[i] += 1
            for j in active:  # less than one block from the given weight, after every slot
                assert abs(placed[j] - start[j] - share[j] * (len(slots) - begin)) < 1
        phases.append(begin)
    return phases, slots


@pytest.mark.parametrize("weights", [[0.9, 0.1], [1, 2, 3, 4, 90], [1, 1, 1], [0.5] + [0.01] * 50, [0.70, *[0.3 / 99] * 99], [7, 1]])
def test_schedule_equals_brute_force(weights):
    rng = random.Random(len(weights))
    blocks = [rng.randint(1, 300 if len(weights) < 10 else 20) for _ in weights]
    phases, slots = mixing.plan(blocks, weights)
    assert (lambda f: ([p.begin for p in phases], slots) == f)(brute(blocks, weights))


def test_many_sources_stay_within_one_block_of_the_given_weights():
    weights = [0.9] + [0.1 / 499] * 499
    exact = [Fraction(str(w)) for w in weights]
    total = sum(exact)
    _, slots = mixing.plan([20_000, *[30] * 499], weights)
    placed = [0] * 500
    for t, i in enumerate(slots[:10_000], 1):
        placed[i] += 1
        if t % 100 == 0:
            assert all(abs(p - t * w / total) < 1 for p, w in zip(placed, exact))


def test_more_sources_than_before_are_no_error():
    phases, slots = mixing.plan([1] * 3000, [1] * 3000)
    assert sorted(slots) == list(range(3000))


def test_every_row_has_its_place(spark):
    rows = documents()
    for block in (None, 2):
        out = mixing.mix(spark.createDataFrame(rows, SHAPE), block=block).collect()
        assert len(out) == len(rows) and sorted(map(str, (tuple(r["row"]) for r in out))) == sorted(map(str, rows))
        assert len({(r["slot"], r["place"]) for r in out}) == len(rows)
        assert all(r["release"] <= r["slot"] < r["deadline"] for r in out)
    assert mixing.mix(spark.createDataFrame([], SHAPE)).collect() == []


def test_weights_are_needed_for_all_sources(spark):
    frame = spark.createDataFrame(documents(), SHAPE)
    with pytest.raises(ValueError):
        mixing.mix(frame, {"big": 1})
    assert mixing.mix(frame, {"big": 3, "small": 1, None: 1}).count() == len(documents())


def test_blocks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    frame = spark.range(1000).selectExpr("id as doc_id", "if(id % 3 = 0, 'a', 'b') as source")
    out = mixing.mix(frame).collect()
    assert len(out) == 1000 and len({r["slot"] for r in out}) <= 12
