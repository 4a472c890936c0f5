import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import SHAPE, documents, sentence
from unitloom.llm import near_copies as parts
from unitloom.llm.common import CLEANUP, materialise, release
from unitloom.llm.near_copies import near_copies, shingles


def changed(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def texts():
    rng = random.Random(4)
    out = [t for _, t, *_ in documents()]
    common = sentence(rng, 12)
    for _ in range(40):
        base = sentence(rng, rng.randint(20, 200))
        out += [base, changed(rng, base, rng.randint(1, 5)), f"{base} {sentence(rng, rng.randint(1, 40))}"]
    out += [f"{common} {sentence(rng, rng.randint(0, 30))}" for _ in range(150)]
    step = sentence(rng, 100)
    for _ in range(30):  # each is near the one before only
        step = changed(rng, step, 1)
        out.append(step)
    return out


def brute(found):
    sets = [shingles(t) for t in found]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if 10 * both >= 8 * (len(sets[i]) + len(sets[j]) - both):
            root[top(j)] = top(i)
    return [top(i) for i in range(len(sets))]


def test_classes_equal_brute_force(spark):
    found = sorted({t or "" for t in texts()})
    frame = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    root = {r["key"]: r["root"] for r in near_copies(frame).collect()}
    keys = [r["k"] for r in frame.orderBy("doc_id").selectExpr("xxhash64(text) as k").collect()]
    got, wanted = [root.get(k, k) for k in keys], brute(found)
    assert len(set(got)) == len(set(wanted)) == len(set(zip(got, wanted)))
    assert near_copies(spark.createDataFrame([], SHAPE)).collect() == []


def test_stage_drops_copies_of_similarity_above_the_threshold(spark, tmp_path):
    rng = random.Random(6)
    base = sentence(rng, 200)
    near = changed(rng, base, 4)
    assert 0.8 <= len(shingles(base) & shingles(near)) / len(shingles(base) | shingles(near)) < 0.95
    docs = spark.createDataFrame([(1, base), (2, near), (3, sentence(rng, 200))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()) == [1, 3]


def test_what_is_shuffled_for_a_table_goes_when_it_is_written(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager()
    shuffled = lambda: sum(manager.diskBlockManager().getAllFiles().apply(i).getName().startswith("shuffle_") for i in range(manager.diskBlockManager().getAllFiles().size()))
    spark.range(10).groupBy(F.col("id") % 3).count().collect()
    before, setting = shuffled(), spark.conf.get(CLEANUP)
    kept = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert shuffled() <= before and spark.conf.get(CLEANUP) == setting and kept.count() == 7
    release(kept)


def test_no_more_parities_differ_than_shingles():
    rng = np.random.default_rng(4)
    for n, m, both in [(1, 1, 0), (5, 400, 3), (300, 320, 290), (64, 65, 64), (1000, 900, 0)]:
        hashes = rng.integers(-(2**63), 2**63 - 1, n + m - both)
        one, other = hashes[:n], hashes[n - both :]
        apart = parts.least_apart(parts.parities(one), parts.parities(other))
        assert apart <= n + m - 2 * both
    assert parts.least_apart(parts.parities(hashes[:800]), parts.parities(hashes[900:1700])) > 300


def test_a_large_group_takes_few_comparisons(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for i in range(240):  # links between about a third of the pairs
        words = list(base)
        for at in rng.sample(range(200), rng.randint(1, 4)):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    counted, verified = [], parts._verified

    def watched(pairs, *rest):
        counted.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(parts, "_verified", watched)
    found = near_copies(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert len({r["root"] for r in found}) == 1 and len(found) == 240
    assert sum(counted) < 6000  # all pairs after one comparison each would be 7,269
