from collections import defaultdict

from tests.llm.fixtures import SHAPE, blank_parted, documents
from unitloom.llm import suffix_dedup


def covered(rows, size=50):
    """Words of each distinct (id, text) in repeated passages, by comparing all windows."""
    places = defaultdict(set)
    for row in rows:
        words = blank_parted(row[1])
        for i in range(len(words) - size + 1):
            places[tuple(words[i : i + size])].add((row[0], row[1], i))
    out = defaultdict(set)
    for held in places.values():
        if len(held) > 1:
            for doc, text, i in held:
                out[doc, text].update(range(i, i + size))
    return out


def test_repeats_equal_brute_force(spark):
    rows = documents()
    found = suffix_dedup.repeats(spark.createDataFrame(rows, SHAPE)).collect()
    from unitloom.llm.common import text_key

    frame = spark.createDataFrame(rows, SHAPE)
    key = {r[0]: r[1] for r in frame.select(text_key(frame.text), "text").distinct().collect()}
    got = defaultdict(set)
    for r in found:
        for s in r["spans"]:
            got[r["id"], key[r["th"]]].update(range(s["start"], s["stop"]))
    assert got == covered(rows)


def test_cut_keeps_each_passage_once_and_all_columns(spark):
    rows = [r for r in documents() if r[0] in (0, 1, 2, 3, 4, 7, 9)]
    frame = spark.createDataFrame(rows, SHAPE)
    out = suffix_dedup.cut_repeats(frame)
    assert out.columns == frame.columns
    kept = out.collect()
    passage = rows[0][1]
    assert sum(passage in (r["text"] or "") for r in kept) == len([r for r in rows if r == rows[0]])
    second = next(r for r in kept if r["doc_id"] == 1)
    assert passage not in second["text"] and len(second["text"].split()) == 60 and second["n_chars"] == len(second["text"])
    assert not any(r["doc_id"] == 4 for r in kept)  # a copy of document 3
    assert any(r["doc_id"] == 7 for r in kept) and any(r["doc_id"] == 9 for r in kept)


def test_empty_table(spark):
    assert suffix_dedup.repeats(spark.createDataFrame([], SHAPE)).collect() == []
    assert suffix_dedup.cut_repeats(spark.createDataFrame([], SHAPE)).collect() == []


def test_without_keeps_what_stands_between():
    assert suffix_dedup.without("a  b\nc d", [[1, 2]]) == "a\nc d"
    assert suffix_dedup.without("a b", [[0, 2]]) == ""


def test_python_gets_few_texts_at_once_and_no_whole_rows(spark):
    from unitloom.llm.common import BATCH, TEXTS, materialise, tidy

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    before = spark.conf.get(BATCH)
    found = materialise(spark.range(5000, numPartitions=1).mapInArrow(tidy(sizes), "n long"), "batches", batch=TEXTS).collect()
    assert sum(r["n"] for r in found) == 5000 and max(r["n"] for r in found) <= TEXTS
    assert spark.conf.get(BATCH) == before
    cut = suffix_dedup.cut_repeats(spark.createDataFrame(documents(), SHAPE))
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan.split("Join")[0] and plan.count("rest(") == 1
