"""A corpus from documents to a training mix: five stages, each one of the operators in tidemark.llm.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of
documents; the last one adds the sampling probability of each document it draws (``mix_prob``, or a
free name like it). Extra columns are handed on as they are, whatever their names.

In every stage an empty table gives an empty table, and null and empty texts are kept unless said
otherwise. Rows that share an id share the decisions made by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, near_text, pii, toxicity
from tidemark.llm.common import stored, table
from tidemark.operators.scale import top_per_key

#: No SQL can express the classifier of the first stage.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents the classifier holds for toxic (score of 0.5 or more). Every row is judged by its
    own text; ids do not matter, and a text without words is kept."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates, and of rows that
    share an id the one whose values come first as text. Rows without an id are kept as they are."""
    groups = near_text.near_groups(docs)
    gone = groups.where("not kept").select(F.col("doc_id").alias("_gone"))
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    if not repeated.limit(1).count():
        return left
    order = [F.col("text").asc_nulls_first(), F.to_json(F.struct(*docs.columns))]
    return top_per_key(left.where("doc_id is not null"), ["doc_id"], order, 1).unionByName(left.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Rows that share an id go together; rows
    without an id are judged by their text."""
    items = table(spark, sf_dir, "benchmark")
    gone = decontaminate.hits(docs, items).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    nameless = left.where("doc_id is null")
    if not nameless.limit(1).count():
        return left
    texts = nameless.select(F.xxhash64("text").alias("doc_id"), "text").distinct()
    found = decontaminate.hits(texts, items).select(F.col("doc_id").alias("_gone")).distinct()
    held = nameless.join(found, F.xxhash64(nameless["text"]) == found["_gone"], "left_anti")
    return left.where("doc_id is not null").unionByName(held)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of every span of personal data; n_chars follows. A null text
    stays null and keeps its n_chars."""
    text = pii.masked(F.col("text"), pii.spans_of(F.col("text")))
    masked = docs.withColumn("text", text)
    return masked.withColumn("n_chars", F.when(
        F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)
    ).otherwise(F.col("n_chars")))


def sample_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents by the raked probabilities; a null id is drawn like the empty string, and rows of
    one id and cell share their fate."""
    return mixing.sampled(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("mixing", sample_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
