"""Near-duplicate documents: min-max hashing proposes, full shingle sets decide.

A document's set holds its distinct shingles of five words (the whole sequence if it has fewer).
Equal sets are merged first, so exact copies cost one row each however many there are. Of every
remaining set each of ``PERMUTATIONS`` hash permutations gives two signature values, the smallest
and the largest image, so 64 hash evaluations per shingle make 128 values. Both agree between two
sets with their Jaccard similarity, and values of different permutations fill one band. With 32
bands of 4 values a pair at similarity 0.75 shares no band with probability (1-0.75^4)^32 = 5e-6.

Buckets never emit all their pairs:

1. every bucket has a hub, the member that meets most others over all its buckets (the centre of a
   group of edited copies), and each member is compared with the hub on the full sets;
2. components of the links found so far show which buckets of three or more sets still hold
   several components. Their members are joined on the rare-first prefixes of their full sets
   under length and position bounds, across components only, which finds every link that is left.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing
and stays. Rows that share a doc_id are one document linked by any of its texts; n_shingles is the
largest of them. Rows with a null doc_id link with nothing and are one row of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, look_up, ship, stored

ship(__name__)

SHINGLE = 5
PERMUTATIONS, BANDS = 64, 32
#: Percent of the union that the intersection must reach.
SIMILAR = 75
BLOCK = 2048

_draw = np.random.default_rng(20240613)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _draw.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _draw.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_ROW = _draw.integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a UTF-8 text."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII spaces only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    size = min(n, SHINGLE)
    total = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        total += h[k:n - size + 1 + k] * _PLACE[k]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest image of the set under every permutation."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        images = shingles[at:at + BLOCK, None] * _TIMES + _PLUS
        np.minimum(low, images.min(0), out=low)
        np.maximum(high, images.max(0), out=high)
    return low, high


def bands(shingles: np.ndarray) -> np.ndarray:
    """One hash per band of two minima and two maxima of four different permutations."""
    low, high = signature(shingles)
    half = np.roll(high, PERMUTATIONS // 2)
    rows = np.stack([low[0::2], low[1::2], half[0::2], half[1::2]])
    return _mixed((rows * _ROW[:, None]).sum(0) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _key(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh128_digest(shingles.tobytes()) if len(shingles) else None


def _fingerprint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"].astype("Int64"), "n_shingles": [len(s) for s in sets],
            "set_key": [_key(s) for s in sets],
            "bands": [bands(s) if len(s) else None for s in sets]})


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        own = [_key(s) == k for s, k in zip(sets, batch["set_key"], strict=True)]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"], "set_key": batch["set_key"], "n": [len(s) for s in sets],
            "shingles": [s.view(np.int64) for s in sets]})[own]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(
        _fingerprint, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, set_key, n, shingles), one row for each ``wanted`` (doc_id, set_key) however often its
    row is repeated."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    found = rows.join(wanted, "doc_id").mapInPandas(
        _sets, "doc_id long, set_key binary, n long, shingles array<long>")
    return found.dropDuplicates(["doc_id", "set_key"])


def _similar(shared: Column, n: Column, m: Column) -> Column:
    return shared * 100 >= (n + m - shared) * SIMILAR


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(one, "a").join(two, "b")
    return both.where(_similar(F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"))).select("a", "b")


def hub_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket (bucket, doc_id, n) with the bucket's hub."""
    met = members.groupBy("doc_id").agg(F.sum("n").alias("met"))
    hubs = members.join(met, "doc_id").groupBy("bucket").agg(
        F.max(F.struct("met", (-F.col("doc_id")).alias("back"))).alias("hub"))
    hubs = hubs.select("bucket", (-F.col("hub.back")).alias("hub"))
    pairs = look_up(members, hubs, "bucket").where("doc_id <> hub")
    return pairs.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def prefix_pairs(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of ``labels`` (doc_id, label) with different labels that can still be similar.

    Two similar sets share a shingle within the n - ceil(0.75 n) + 1 rarest ones of both.
    """
    tokens = sets.join(labels, "doc_id").select(
        "doc_id", "set_key", "label", "n", F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    ordered = look_up(tokens, counts, "token").groupBy("doc_id", "set_key", "label", "n").agg(
        F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"))
    length = F.col("n") - F.ceil(F.col("n") * SIMILAR / 100) + 1
    prefix = ordered.select("doc_id", "label", "n", F.posexplode(F.slice("t", F.lit(1), length.cast("int"))))
    prefix = stored(prefix.where("col.f > 1").select(
        "doc_id", "label", "n", F.col("pos").alias("at"), F.col("col.token").alias("token")), "prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    left = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    return a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.doc_id") < F.col("b.doc_id"))
                  & (F.col("a.label") != F.col("b.label"))
                  & _similar(left, F.col("a.n"), F.col("b.n"))
                  ).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()


def near_links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all similar sets of ``reps`` (doc_id, set_key, bands)."""
    spread = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(look_up(spread, shared, "bucket"), "buckets")
    wanted = members.select("doc_id").distinct().join(reps.select("doc_id", "set_key"), "doc_id")
    sets = stored(shingle_sets(docs, wanted), "sets")
    found = stored(links(hub_pairs(members), sets), "hub-links")
    nodes = connected_components(found).withColumnRenamed("node", "doc_id")
    labelled = stored(
        members.join(nodes, "doc_id", "left")
        .select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("label")), "labels")
    mixed = (
        labelled.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        .where("n > 2 and lo <> hi").select("bucket")
    )
    open_docs = stored(look_up(labelled, mixed, "bucket").select("doc_id", "label").distinct(), "open")
    rest = links(stored(prefix_pairs(sets, open_docs), "prefix-pairs"), sets)
    return found.unionByName(stored(rest, "prefix-links"))


def near_groups(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    marks = stored(fingerprints(docs), "fingerprints")
    known = marks.where("doc_id is not null and set_key is not null")
    reps = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "bands")).alias("r"))
    reps = stored(reps.select("set_key", "r.doc_id", "r.bands"), "representatives")
    rows = marks.join(reps.select("set_key", F.col("doc_id").alias("rep")), "set_key", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    rows = rows.withColumn("rep", own).select("doc_id", "n_shingles", "rep")
    each = rows.groupBy("doc_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.min("rep").alias("rep"))
    same = rows.join(each.select("doc_id", F.col("rep").alias("first")), "doc_id").where("rep <> first")
    found = near_links(docs, reps).unionByName(same.select(F.col("first").alias("a"), F.col("rep").alias("b")))
    nodes = connected_components(found).withColumnRenamed("node", "rep")
    component = F.coalesce("component", "rep")
    return each.join(nodes, "rep", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"))
