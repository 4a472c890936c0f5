import math
import random

import numpy as np

from tests.llm.fixtures import SHAPE, documents, sentence
from unitloom.llm import toxicity


def corpus(n=900):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randint(20, 200)).split()
        bad = rng.random() < 0.25
        if bad:
            for _ in range(max(2, len(words) // 15)):
                words[rng.randrange(len(words))] = rng.choice(["wretchling", "fumblewit", "scoundrel"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy():
    rows, labels = corpus()
    model = toxicity.fit([t for _, t in rows[:600]], [y for _, y in labels[:600]])
    predicted = model.score([t for _, t in rows[600:]]) >= 0.5
    assert sum(p == y for p, (_, y) in zip(predicted, labels[600:])) / 300 > 0.95


def test_scores_of_awkward_rows(spark):
    rows, labels = corpus()
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    found = toxicity.scores(spark.createDataFrame(documents(), SHAPE), model).collect()
    assert len(found) == len(documents()) and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.scores(spark.createDataFrame([], SHAPE), model).collect() == []


def test_drop_keeps_clean_rows_and_columns(spark):
    rows, labels = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1.5D as score", "'x' as row")
    out = toxicity.drop_toxic(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert out.columns == frame.columns
    kept = {r["doc_id"] for r in out.collect()}
    clean = {i for i, y in labels if not y}
    assert len(kept & clean) > 0.95 * len(clean) and len(kept - clean) < 0.1 * len(labels) / 4


def test_without_labels_every_text_gets_the_prior(spark):
    model = toxicity.train(spark.createDataFrame(documents(), SHAPE), spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.score(["a", None, ""]).tolist() == [0.0, 0.0, 0.0]


def plain_lengths(model, content, text):
    """Compressed length of every window, one by one."""
    data = toxicity._normal(text)
    starts = range(0, max(1, len(data) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)
    compressor = toxicity._compressor(content)
    return [len(compressor.compress(data[i : i + toxicity.WINDOW])) if data else 0 for i in starts]


def test_features_equal_a_plain_version():
    rows, labels = corpus(300)
    model = toxicity.fit([t for _, t in rows], [y for _, y in labels])
    texts = [t for _, t in rows[:20]] + ["", "a", None, "x " * 500]
    found = model.features([toxicity._normal(t) for t in texts])
    for row, text in zip(found, texts):
        gain = [a - b for a, b in zip(plain_lengths(model, model.ordinary, text), plain_lengths(model, model.toxic, text))]
        for k, least in enumerate(toxicity.DIFFERENCES):
            above = sum(g >= least for g in gain)
            assert abs(row[2 * k] - math.log1p(above)) < 1e-9 and abs(row[2 * k + 1] - above / len(gain)) < 1e-9
        assert row[-2] == max(gain) and abs(row[-1] - math.log(len(gain))) < 1e-9


def test_each_class_has_its_own_dictionary():
    rows, labels = corpus()
    model = toxicity.fit([t for _, t in rows], [y for _, y in labels])
    assert len(model.toxic) == len(model.ordinary) and model.toxic != model.ordinary
    assert all(w in model.toxic[-toxicity.TAIL_BYTES :] for w in (b"wretchling", b"fumblewit", b"scoundrel"))
    assert not any(w in model.ordinary[-toxicity.TAIL_BYTES :] for w in (b"wretchling", b"fumblewit", b"scoundrel"))


def test_the_sample_is_bounded_and_repeats_are_settled(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame([*rows, *rows, (0, "another text"), (1, None)], "doc_id long, text string")
    frame = spark.createDataFrame([*labels, *labels], "doc_id long, toxic int")
    one, two = toxicity.train(docs, frame), toxicity.train(docs.repartition(7), frame)
    assert one.toxic == two.toxic and one.prior == two.prior
    assert toxicity.train(docs, frame, size=0).prior == 0.0


def test_the_last_word_of_a_dictionary_shortens_windows():
    rng = random.Random(3)
    body = " ".join(sentence(rng, 50) for _ in range(20))
    texts = []
    for _ in range(60):
        a, b = rng.sample(range(len(body) - 30), 2)
        texts.append(toxicity._normal(f"{body[a : a + 26].strip()} wretch {body[b : b + 18].strip()}"))
    sample = toxicity._Sample(texts, toxicity._normal(body))
    assert (sample.gain(b" wretch ", np.arange(60)) >= 2).mean() > 0.5
