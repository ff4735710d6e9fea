"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Items are cut into windows of ``WINDOW`` words (an item of fewer words is one window). A window is
a set of positioned shingles, and it must be contained in a document whole, so of its shingles
ordered by rarity a prefix of one, the rarest, has to occur there:

1. every document's shingles meet the item shingles once; each hit keeps the words around it,
2. hits are counted per shingle over the whole corpus, which gives the rarity order,
3. each window joins the hits of its rarest shingle; position and length bounds drop windows that
   would begin before or end after the document,
4. the words around the hit are compared with the window, word for word.

Defined results: a null or empty text, or one without words, has no words and no hits. Items
without words match nothing. Equal windows of several items count for each item. Rows that share a
doc_id are one document: each text is looked at on its own, the largest word count is given, hit
positions are counted once. Rows with a null doc_id are one row of the result, never contaminated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import look_up, lower_ascii, stored

WINDOW = 10
SHINGLE = 5
#: Runs of digits, letters and characters beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Item shingles go to every task if they are at most this many (24 bytes each, 5 MB); they are
#: counted first. Beyond it both sides are shuffled, the documents as one short row per word
#: position, and the words near a hit are taken from the texts that have one afterwards.
SENT_SHINGLES = 200_000


def words_of(text: Column) -> Column:
    """Lower-cased words in order, none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: window_id, words, length, and the item_ids that hold each."""
    cut = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    cut = cut.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(
        F.xxhash64("words").alias("window_id"), "words", F.size("words").alias("length"), "item_ids")


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(window_id, words, length, size, offset, key): the positioned shingles of every window."""
    size = F.least(F.lit(shingle), F.col("length"))
    out = windows.select("window_id", "words", "length", size.alias("size"),
                         F.explode(F.sequence(F.lit(0), F.col("length") - size)).alias("offset"))
    key = F.xxhash64(F.concat_ws(" ", F.slice("words", F.col("offset") + 1, F.col("size"))))
    return out.withColumn("key", key)


def document_hits(docs: DataFrame, shingles: DataFrame, sizes: list[int], reach: int) -> DataFrame:
    """(doc_id, n_words, at, key, before, around): where item shingles occur, with the words near.

    ``around`` holds up to ``reach`` words on both sides of position ``at``, of which ``before``
    come ahead of it, so later steps need neither the text nor the word list again.
    """
    split = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    keys = shingles.select("key").distinct()
    if keys.count() <= SENT_SHINGLES:
        found = reduce(DataFrame.unionByName, [
            _positions(split, size).join(F.broadcast(keys), "key") for size in sizes])
    else:
        places = reduce(DataFrame.unionByName, [_positions(split, size).drop("w") for size in sizes])
        held = look_up(places, keys, "key").groupBy("doc_id", "text_key").agg(
            F.collect_set(F.struct("at", "key")).alias("hits"))
        found = split.join(held, ["doc_id", "text_key"]).select("doc_id", "w", F.inline("hits"))
    before = F.least(F.col("at"), F.lit(reach))
    return found.select(
        "doc_id", F.size("w").alias("n_words"), "at", "key", before.alias("before"),
        F.slice("w", F.col("at") + 1 - before, before + reach).alias("around"))


def _positions(split: DataFrame, size: int) -> DataFrame:
    """``split`` with a row per position ``at`` and the ``key`` of the ``size`` words from there."""
    last = F.size("w") - size
    # The outer form keeps Spark from adding a filter that would split the text once more;
    # texts with fewer words give a null key, which joins nothing.
    at = F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last)))
    words = [F.get("w", F.col("at") + i) for i in range(size)]
    key = F.when(F.col("at").isNotNull(), F.xxhash64(F.concat_ws(" ", *words)))
    return split.select("*", at.alias("at")).withColumn("key", key)


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, start, length, window_id, item_ids) for every occurrence of an item window."""
    windows = stored(windows_of(items, window), "windows")
    shingles = window_shingles(windows, shingle)
    # At most ``shingle`` distinct sizes.
    sizes = sorted(r[0] for r in shingles.select("size").distinct().collect())
    if not sizes:
        none = windows.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).alias("start"),
                              "length", "window_id", "item_ids")
        return none.where(F.lit(False))
    found = stored(document_hits(docs.where(F.col("doc_id").isNotNull()), shingles, sizes, window),
                   "shingle-hits")
    counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("window_id").orderBy("n", "key", "offset")
    # A window with a shingle that no document has cannot occur at all: the inner rarity is 0.
    prefix = (
        shingles.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("rank", F.row_number().over(rarest)).where("rank = 1 and n > 0")
        .drop("rank", "n", "size")
    )
    begin = F.col("at") - F.col("offset")
    matched = found.join(prefix, "key").where(
        (begin >= 0) & (begin + F.col("length") <= F.col("n_words"))
        & (F.slice("around", F.col("before") - F.col("offset") + 1, F.col("length")) == F.col("words")))
    matched = matched.select("doc_id", begin.alias("start"), "length", "window_id")
    return matched.join(windows.select("window_id", "item_ids"), "window_id")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW,
                   shingle: int = SHINGLE) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (sorted as strings)."""
    occurrences = stored(hits(docs, items, window, shingle), "occurrences")
    ends = F.col("start") + F.col("length")
    seen = Window.partitionBy("doc_id").orderBy("start", "ends").rowsBetween(
        Window.unboundedPreceding, -1)
    spans = occurrences.select("doc_id", "start", ends.alias("ends")).distinct()
    fresh = F.col("ends") - F.greatest("start", F.coalesce(F.max("ends").over(seen), F.lit(0)))
    covered = (
        spans.withColumn("fresh", F.greatest(fresh, F.lit(0)))
        .groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"))
    )
    items_hit = (
        occurrences.select("doc_id", F.explode("item_ids").alias("item_id"))
        .groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    base = (
        docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
        .groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    )
    return (
        base.join(covered.join(items_hit, "doc_id"), "doc_id", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    )
