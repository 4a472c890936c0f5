import random

import corpus_pipeline
from tests.llm.fixtures import SHAPE, documents, sentence


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(8)
    clean = [sentence(rng, 120) for _ in range(120)]
    passage, leak = sentence(rng, 70), sentence(rng, 30)
    texts = [*clean, clean[0], f"{sentence(rng, 80)} {passage}", f"{passage} {sentence(rng, 80)}", f"{sentence(rng, 40)} {leak}", None, ""]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
        assert state.columns == docs.columns, name
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(range(120)) <= set(out) and 120 not in out  # a copy
    assert 123 not in out  # holds a benchmark item
    assert sum(passage in (out[i]["text"] or "") for i in (121, 122)) == 1
    assert len({(r["slot"], r["place"]) for r in out.values()}) == len(out)


def test_copies_go_by_id_and_text(spark, tmp_path):
    rng = random.Random(9)
    one, two, three, four = (sentence(rng, 60) for _ in range(4))
    rows = [(1, one), (None, one), (None, two), (None, three), (2, one), (2, four)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()]
    assert sorted(kept, key=str) == sorted([(1, one), (None, two), (None, three), (2, four)], key=str)
    fixture = spark.createDataFrame(documents(), SHAPE)
    kept = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, fixture, str(tmp_path)).collect()}
    texts = [t for _, t, *_ in documents()]
    assert (5, "another text under a used id") in kept and (0, texts[0]) in kept and (3, texts[3]) in kept
    assert (4, texts[4]) not in kept and (None, texts[3]) not in kept and not any(i is None for i, _ in kept)
