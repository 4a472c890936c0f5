"""License notices in documents by an exact set-similarity join. DataFrame functions alone do the work.

A template is a set of words, a block (a line, or a paragraph where blank lines part the text) another. A block meets a
template if it holds ``threshold`` of its words or more. Words are ordered by how many blocks of the whole corpus hold them,
rarest first. A block that meets a template T must hold one of the first ``|T| - ceil(threshold * |T|) + 1`` words of T
(prefix filter), have enough words of templates at all (length filter), and enough of them at and after the first that
both hold (positional filter). What passes is verified exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.llm.common import materialise, plain_words, table, text_key

THRESHOLD = 0.8
#: Label and text of each template.
TEMPLATES = {
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "gpl-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-or-later": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mit-notice": "released under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
}
#: Phrases that label a document wherever their words stand consecutively.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: One word that every phrase ends with: only texts that hold it are searched.
LAST_WORD = "license"
PARAGRAPH_BREAK = r"\n[ \t\r]*\n+"


def template_words(templates: dict[str, str] = TEMPLATES) -> dict[str, list[str]]:
    return {label: sorted(set(text.split())) for label, text in templates.items()}


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``key`` (of the text), ``label`` and ``share``: the largest part of the template's words in one block, for all
    documents and templates with a block of at least ``threshold``."""
    spark = docs.sparkSession
    sets = template_words(templates)
    needed = {label: math.ceil(round(threshold * len(own), 9)) for label, own in sets.items()}
    vocabulary = sorted(set().union(*sets.values()))
    text = F.col(text_col).cast("string")
    whole = F.when(text.rlike(PARAGRAPH_BREAK), F.split(text, PARAGRAPH_BREAK)).otherwise(F.array().cast("array<string>"))
    blocks = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), F.explode(F.concat(F.split(text, "\n"), whole)).alias("block"))
    listed = F.array(*(F.lit(w) for w in vocabulary))
    held = blocks.select("id", "key", F.array_intersect(plain_words(F.col("block")), listed).alias("words"))
    held = materialise(held.where(F.size("words") >= min(needed.values())), "license-words")  # length filter for the easiest template
    found = {r["word"]: r["n"] for r in held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # words of templates only
    place = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (found.get(w, 0), w)))}
    ordered = [sorted(own, key=place.get) for own in sets.values()]
    rows = [(word, label, i, need, own, place[word]) for (label, need), own in zip(needed.items(), ordered, strict=True) for i, word in enumerate(own[: len(own) - need + 1])]
    prefixes = spark.createDataFrame(rows, "word string, label string, i int, need int, own array<string>, at int")
    order = F.create_map(*(x for w, p in place.items() for x in (F.lit(w), F.lit(p))))
    sized = held.select("id", "key", "words", F.array_intersect("words", F.array(*(F.lit(w) for w in sorted({r[0] for r in rows})))).alias("rare")).where(F.size("rare") > 0)
    paired = sized.select("id", "key", "words", F.explode("rare").alias("word")).join(F.broadcast(prefixes), "word")  # the table has as many rows as templates have prefix words
    # Only the first shared word of a pair counts; at it, the words of either side from there on bound the overlap.
    later = F.size(F.filter("words", lambda w: F.element_at(order, w) >= F.col("at")))
    earlier = F.exists(F.slice("own", 1, F.col("i")), lambda w: F.array_contains("words", w))
    passed = paired.where((F.size("words") >= F.col("need")) & (F.least(F.size("own") - F.col("i"), later) >= F.col("need")) & ~earlier)
    overlap = F.size(F.array_intersect("words", "own"))
    met = passed.select("id", "key", "label", "need", overlap.alias("overlap"), (overlap / F.size("own")).alias("share")).where("overlap >= need")
    return met.groupBy("id", "key", "label").agg(F.max("share").alias("share"))


def _places(words: str):
    """Start and label of every phrase, in order of the text."""

    def of(phrase: tuple[str, ...], label: str):
        here = lambda i: F.array(*(F.get(F.col(words), i + k) == w for k, w in enumerate(phrase)))
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), lambda i: F.forall(here(i), lambda same: same))
        found = F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
        return F.when(F.size(words) >= len(phrase), found).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))

    return F.concat(*(of(phrase, label) for phrase, label in PHRASES.items()))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's ``id``, ``n_words``, ``places`` (word and label of each base phrase), ``found`` (labels of templates met)
    and ``share`` (the best; 0 without any).

    A null text is empty and has no words; an empty table gives no rows; rows with equal id and text have equal results;
    null ids are kept. A word repeated in a block counts once.
    """
    met = matches(docs, templates, threshold, id_col, text_col).groupBy("id", "key").agg(F.array_sort(F.collect_set("label")).alias("found"), F.max("share").alias("share"))
    met = met.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "found", "share")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), plain_words(text).alias("words"))
    places = F.when(F.array_contains("words", LAST_WORD), _places("words")).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))
    own = own.select("id", "key", F.size("words").cast("long").alias("n_words"), places.alias("places"))
    joined = own.join(met, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left")
    return joined.select("id", "n_words", "places", F.coalesce("found", F.array().cast("array<string>")).alias("found"), F.coalesce("share", F.lit(0.0)).alias("share"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.array_distinct(F.transform("places", lambda p: p.label))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p.at)).alias("first_word"), F.array_max(F.transform("places", lambda p: p.at)).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, "found")), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.col("share")).alias("score"),
    )


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_PLACES = " UNION ALL ".join(f"SELECT rid, i - 1 AS place, '{label}' AS label FROM d, unnest(range(1, len(w) - {len(p) - 2})) t(i) WHERE {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p))}" for p, label in PHRASES.items())
_SETS = ", ".join(f"('{label}', {own!r}, {math.ceil(round(THRESHOLD * len(own), 9))})" for label, own in template_words().items())

SQL = {
    "op8_licenses": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, regexp_extract_all({_LOWER}, {_RUNS}) AS w FROM documents),
p AS ({_PLACES}),
base AS (SELECT rid, count(*) AS n, min(place) AS a, max(place) AS z, array_to_string(list_sort(list(DISTINCT label)), ',') AS l FROM p GROUP BY rid),
b AS (SELECT rid, unnest(list_concat(string_split({_LOWER}, chr(10)), CASE WHEN regexp_matches(text, '\n[ \t\r]*\n+') THEN string_split_regex({_LOWER}, '\n[ \t\r]*\n+') ELSE [] END)) AS block FROM d),
s AS (SELECT rid, list_distinct(regexp_extract_all(block, {_RUNS})) AS own FROM b),
t(label, words, need) AS (VALUES {_SETS}),
m AS (SELECT rid, label, max(len(list_intersect(own, words)) / CAST(len(words) AS DOUBLE)) AS share FROM s, t WHERE len(list_intersect(own, words)) >= need GROUP BY rid, label),
f AS (SELECT rid, list(label) AS l, max(share) AS share FROM m GROUP BY rid),
labels2 AS (SELECT rid, array_to_string(list_sort(list(DISTINCT label)), ',') AS l FROM (SELECT rid, label FROM p UNION SELECT rid, label FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
  coalesce(base.l, '') AS base_labels, coalesce(labels2.l, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN f USING (rid) LEFT JOIN labels2 USING (rid)
""",
}
QUERIES = {"op8_licenses": op8_licenses}
