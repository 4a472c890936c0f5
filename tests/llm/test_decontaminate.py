import random
import time

from tests.llm.fixtures import SHAPE, documents, plain, sentence
from unitloom.llm import decontaminate


def items():
    rows = documents()
    words = rows[0][1].split()
    return [(1, " ".join(words[5:25])), (2, "den meister"), (3, None), (4, ""), (5, "a"), (None, "one two"), (6, " ".join(words[20:31])), (6, "never seen here at all today my friend says so often"), (7, "x x x x x x x x x x x x")]


def brute(text, bench):
    words, hit, held = plain(text), set(), set()
    for item, body in bench:
        own = plain(body)
        n = min(10, len(own))
        for s in range(len(own) - n + 1) if n else ():
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[s : s + n]:
                    hit.update(range(i, i + n))
                    held |= {str(item)} if item is not None else set()
    return len(words), len(hit), sorted(held)


def test_contamination_equals_brute_force(spark):
    rows, bench = documents(), items()
    found = decontaminate.contamination(spark.createDataFrame(rows, SHAPE), spark.createDataFrame(bench, "item_id long, text string")).collect()
    got = sorted(((r["id"], r["n_words"], r["n_hit"], r["items"]) for r in found), key=str)
    assert got == sorted(((r[0], *brute(r[1], bench)) for r in rows), key=str)


def test_drop_keeps_clean_rows_and_columns(spark):
    rows, bench = documents(), items()
    frame = spark.createDataFrame(rows, SHAPE)
    out = decontaminate.drop_contaminated(frame, spark.createDataFrame(bench, "item_id long, text string"))
    assert out.columns == frame.columns
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted((r for r in rows if not brute(r[1], bench)[1]), key=str)


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame(documents(), SHAPE), spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(docs, bench).collect())
    assert decontaminate.contamination(spark.createDataFrame([], SHAPE), spark.createDataFrame(items(), "item_id long, text string")).collect() == []


def test_work_follows_the_length_of_a_text(spark):
    rng = random.Random(5)
    words = sentence(rng, 400_000).split()
    item = words[200_000:200_012]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    began = time.perf_counter()
    found = decontaminate.contamination(docs, items).collect()
    assert time.perf_counter() - began < 30
    assert [(r["n_words"], r["n_hit"]) for r in found] == [(400_000, 12)]


def test_a_full_table_of_bits_changes_nothing(spark, monkeypatch):
    rng = random.Random(6)
    texts = [sentence(rng, 60) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(t.split()[i : i + 14])) for i, t in enumerate(texts[::3])], "item_id long, text string")
    columns = ["id", "n_words", "n_hit", "items"]
    one = sorted(map(str, decontaminate.contamination(docs, items).select(columns).collect()))
    monkeypatch.setattr(decontaminate, "MOST_BITS", 64)
    assert one == sorted(map(str, decontaminate.contamination(docs, items).select(columns).collect()))
