import math
from collections import Counter

import numpy as np

from tests.llm.fixtures import SHAPE, blank_parted, documents
from unitloom.llm import hmm


def slow(model, classes):
    """One text's likelihood and expected counts, word by word."""
    ahead, log = [], 0.0
    a = model.start * model.emit[:, classes[0]]
    for t, c in enumerate(classes):
        a = a if t == 0 else a @ model.move * model.emit[:, c]
        log += math.log(a.sum())
        a = a / a.sum()
        ahead.append(a)
    late, starts, moves, emitted = np.ones(len(model.start)), 0, np.zeros_like(model.move), np.zeros_like(model.emit)
    for t in range(len(classes) - 1, -1, -1):
        gamma = ahead[t] * late / (ahead[t] * late).sum()
        emitted[:, classes[t]] += gamma
        if t:
            joint = ahead[t - 1][:, None] * model.move * (model.emit[:, classes[t]] * late)
            moves += joint / joint.sum()
        else:
            starts = gamma
        late = model.move @ (model.emit[:, classes[t]] * late)
        late /= late.sum()
    return log, starts, moves, emitted


def test_forward_and_counts_equal_the_plain_recursion():
    rng = np.random.default_rng(1)
    share = rng.random(hmm.CLASSES + 2)
    model = hmm.initial(share / share.sum())
    lengths = np.array([1, 5, 64, 65, 130, 7, 200])
    classes = rng.integers(0, hmm.CLASSES + 2, lengths.sum())
    log, starts, moves, emitted = hmm.forward(model, classes, lengths, counts=True)
    parts = [slow(model, c) for c in np.split(classes, np.cumsum(lengths)[:-1])]
    assert np.allclose(log, [p[0] for p in parts], rtol=1e-12)
    for got, k in ((starts, 1), (moves, 2), (emitted, 3)):
        assert np.allclose(got, sum(p[k] for p in parts), atol=1e-9)


def test_base_scores_and_probabilities_add_up(spark):
    rows = documents()
    frame = spark.createDataFrame(rows, SHAPE)
    held = hmm.F.coalesce(hmm.F.col("doc_id") % 3 == 0, hmm.F.lit(False))
    found, total = hmm.language_model_scores(frame, held)
    out = found.collect()
    tokens = [(r[0], r[0] is not None and r[0] % 3 == 0, [*blank_parted(r[1]), b"\n"]) for r in rows]
    counts = Counter(w for _, h, ws in tokens if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert total == n
    want = sorted((str(i), h, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, h, ws in tokens)
    assert sorted((str(r["id"]), r["held"], r["n_tokens"], r["n_known"], round(r["base"], 6)) for r in out) == want
    assert all(r["score"] < 0 for r in out)
    corpus = hmm.gather(frame, held)
    model = hmm.train(corpus)
    assert np.allclose(model.emit.sum(axis=1), 1) and np.allclose(model.move.sum(axis=1), 1) and abs(model.start.sum() - 1) < 1e-9


def test_without_training_rows_and_empty(spark):
    frame = spark.createDataFrame(documents(), SHAPE)
    found, total = hmm.language_model_scores(frame, hmm.F.lit(True))
    assert total == 0 and found.count() == len(documents())
    assert hmm.language_model_scores(frame.limit(0), hmm.F.lit(False))[0].collect() == []
