"""Registered queries of the corpus operators; each derives its columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontaminate, html_text, language, mixing, near_text, near_vectors, ngram, pii, prefix_trie, spelling,
    toxicity, url_filter, warc,
)
from tidemark.llm.common import fold_of, table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(pii.BASE_KINDS))
    counts = [pii.count_of("spans", k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    return docs.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"),
                       pii.joined(F.col("spans")).alias("spans"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminated(table(spark, sf_dir, "documents"),
                                         table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"),
                         toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op3_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_groups(table(spark, sf_dir, "documents"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "source", "lang", "topic", "tokens",
                      F.round("cell_weight", 6).alias("cell_weight"),
                      F.round("prob", 6).alias("prob"), "sampled")


@query
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_groups(table(spark, sf_dir, "embeddings"))


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


@query
def op6_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(table(spark, sf_dir, "documents"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are fetched on a day of 2024 that follows from the page_id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    judged = url_filter.judge(pages.withColumn("fetched", fetched), url_filter.entries_of_hosts(pages))
    return judged.select("page_id", "url", F.col("fetched").cast("string").alias("fetched"), "verdict",
                         "pattern", F.col("valid_from").cast("string").alias("valid_from"))


@query
def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).drop("shares")


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes_of(table(spark, sf_dir, "conversations"))
