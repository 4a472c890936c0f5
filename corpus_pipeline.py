"""From raw documents to a mixed training corpus: each stage works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitloom.llm import decontaminate, mixing, simhash, suffix_dedup, toxicity
from unitloom.llm.common import shared_dir, table, text_key


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay. The classifier is fitted on the labelled ones among ``docs``; without labels of both
    kinds all get their mean. Null and empty texts are scored like others; rows that are equal fare alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays (a null id comes last, then the hash of the text
    decides); texts of which 0.8 of the five-word shingles agree (Jaccard) are linked. Rows are told apart by id and text:
    other texts under the same id, null or not, stand for themselves. Of rows equal in both one stays."""
    rows = docs.select(F.col("doc_id").alias("_doc"), text_key(F.col("text")).alias("_key")).distinct()
    classed = rows.join(simhash.similar_texts(docs).withColumnRenamed("key", "_key"), "_key", "left").select("_doc", "_key", F.coalesce("root", "_key").alias("_class"))
    first = F.struct(F.col("_doc").isNull().alias("none"), F.col("_doc").alias("id"), F.col("_key").alias("key"))
    kept = classed.groupBy("_class").agg(F.min(first).alias("_first")).select(F.col("_first.id").alias("_id"), F.col("_first.key").alias("_text"))
    # Plain keys, the same for the join and the copies, so that whole rows are shuffled once.
    plain = lambda id_col, key: (F.col(id_col).isNull().alias("_none"), F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("_id"), F.col(key).alias("_key"))
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), text_key(F.col("text")).alias("_own")).select("_row", *plain("_doc", "_own"))
    found = packed.join(kept.select(*plain("_id", "_text")), ["_none", "_id", "_key"], "left_semi")
    # Rows of one id and text are copies too.
    return found.dropDuplicates(["_none", "_id", "_key"]).select("_row.*")


def repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only where they stand first, by id, then the hash of the text; a document without any
    other words goes, one that never had any stays. Rows equal in id and text are one text."""
    return suffix_dedup.cut_repeats(docs)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot in the mixture; a null source is a source of its own."""
    found = mixing.mix(docs)
    return found.select("row.doc_id", "row.source", "row.text", "phase", "block", "slot", "place")


STAGES = [("toxicity", toxic), ("near_duplicates", near_copies), ("suffix_dedup", repeated), ("decontamination", leaked), ("mixing", mixed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/unitloom-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
