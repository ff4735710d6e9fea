"""Prefix trie of conversations, built as a z-fast trie.

A conversation is a path of turns. Its prefixes are told apart by hashes: the prefix of depth d is the
exclusive or of one 128-bit number per turn and place, together with its length in characters. Only a
conversation's hashes travel, as one row of 24 bytes a turn, never its texts.

The compacted trie is a table with one row per branching or end point: its *extent* (prefix hash at
depth ``len``), the depth ``up`` where its parent ends, the prefix hashes along the edge between them,
and its *handle*, the prefix hash at the 2-fattest depth in (up, len]: the one that the largest power
of two divides. A path is located by fat binary search: of the depths that are still open the
2-fattest is looked up among the handles; a node whose whole extent is a prefix of the path raises the
lower end, one that is not ends the search, none lowers the upper end. That takes as many joins as the
longest path's length has bits, whatever the trie holds. The path leaves the trie on the edge that
goes on with its next prefix.

Distinct paths are inserted in batches, each located in the trie of those before. Edges are split where
paths leave them; below that the batch's own branching points are prefixes with several continuations,
found by sums per prefix, and each new edge is cut from the path with the smallest id that goes through
it. Copies of a path are one row with a count, so a conversation that a third of all others repeat is
located once.

Numbers of a subtree are sums over the paths that end in it, combined before the shuffle; along an
edge they follow from the lengths, so expanding the edges to one node per turn needs no further join.

Defined results: turns without a number come first, equal numbers are ordered by their content's hash.
A null role or text is empty. Rows without a conv_id belong to no conversation. A conversation without
turns ends at the root. No conversation gives no node, not even the root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import ship, stored

ship(__name__)

PERIOD, MOST_SHARED = 100, 6
#: Share of the distinct paths that are in the trie after each batch.
BATCHES = (1 / 16, 1 / 4, 1.0)
#: Consecutive ids whose list is one text when the ends of a node are hashed.
ENDS = 4096
PREFIX = "struct<a:bigint,b:bigint,c:bigint>"
TRIE = f"id {PREFIX}, len int, up int, up_id {PREFIX}, edge array<{PREFIX}>, owner long"

_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


# ---- conversations as paths -------------------------------------------------------------------
def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): per turn two content hashes and its length, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"),
        F.char_length(text).cast("long").alias("chars"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    return rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", *[F.col(f"t.{c}").alias(c) for c in ("a", "b", "chars")])


def rebuilt(turns: DataFrame, period: int = PERIOD, most: int = MOST_SHARED) -> DataFrame:
    """Every conversation begins with the first h turns of the first conversation of its ``period``,
    and goes on with its own turns after its first h; h is the id's checksum modulo ``most``."""
    parts = ("a", "b", "chars")
    heads = turns.where(F.col("conv_id") % period == 0).select(
        F.col("conv_id").alias("head"), *[F.slice(c, 1, most).alias(f"head_{c}") for c in parts])
    rows = turns.withColumn("head", F.col("conv_id") - F.col("conv_id") % period)
    rows = rows.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))

    def joined(c: str) -> Column:
        begun = F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("h")), F.array().cast("array<long>"))
        own = F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))
        return F.concat(begun, own).alias(c)

    return rows.join(heads, "head", "left").select("conv_id", *[joined(c) for c in parts])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def prefixes(codes: np.ndarray, place: np.uint64) -> np.ndarray:
        codes = np.asarray(codes, np.int64).view(np.uint64)
        depth = np.arange(1, len(codes) + 1, dtype=np.uint64)
        found = np.bitwise_xor.accumulate(_mixed(codes ^ _mixed(depth * place)))
        return np.concatenate([[np.uint64(0)], found]).view(np.int64)

    for batch in batches:
        yield pd.DataFrame({
            "conv_id": batch["conv_id"], "a": [prefixes(x, _PLACE[0]) for x in batch["a"]],
            "b": [prefixes(x, _PLACE[1]) for x in batch["b"]],
            "c": [np.concatenate([[0], np.cumsum(np.asarray(x, np.int64))]) for x in batch["chars"]]})


def paths_of(turns: DataFrame) -> DataFrame:
    """(conv_id, n, path): the prefix hashes and lengths at depths 0 to n."""
    found = turns.mapInPandas(_paths, "conv_id long, a array<long>, b array<long>, c array<long>")
    return found.select("conv_id", (F.size("a") - 1).alias("n"),
                        F.arrays_zip("a", "b", "c").cast(f"array<{PREFIX}>").alias("path"))


def at_depth(path: str, depth: Column) -> Column:
    return F.element_at(path, (depth + 1).cast("int"))


# ---- fat binary search ---------------------------------------------------------------------------
def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the largest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high).cast("long"))) - 1
    step = F.call_function("shiftleft", F.lit(1), bits)
    return (F.floor(high / step) * step).cast("int")


def handled(trie: DataFrame) -> DataFrame:
    """The trie with its handles."""
    place = fattest(F.col("up"), F.col("len")) - F.col("up")
    return trie.withColumn("handle", F.element_at("edge", place.cast("int")))


def _meet(rows: DataFrame, key: Column, nodes: DataFrame, by: str) -> DataFrame:
    """Left join on a prefix that may be null. Rows without one get a prefix of their own that no
    node has, so that they spread; joining on a hash as well lets Spark split frequent prefixes."""
    none = F.struct(F.col("seq").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(-1).cast("long").alias("c"))
    rows = rows.withColumn("_key", F.coalesce(key, none)).withColumn("_code", F.xxhash64("_key"))
    nodes = nodes.withColumnRenamed(by, "_key").withColumn("_code", F.xxhash64("_key"))
    return rows.join(nodes, ["_key", "_code"], "left").drop("_key", "_code")


def located(paths: DataFrame, trie: DataFrame) -> DataFrame:
    """The paths (seq, n, path, ...) with ``lcp``, the depth at which each leaves the trie, and the node
    (exit_id, exit_len) on whose edge that is; null where the path leaves from the end of an edge."""
    longest = paths.agg(F.max("n")).head()[0] or 0
    found = paths.withColumns({"lo": F.lit(0), "hi": F.col("n")})
    nodes = handled(trie).select("handle", F.col("id").alias("t_id"), F.col("len").alias("t_len"), F.col("up").alias("t_up"))
    for _ in range(longest.bit_length()):
        place = fattest(F.col("lo"), F.col("hi"))
        found = found.withColumn("at", F.when(F.col("lo") < F.col("hi"), place))
        found = _meet(found, F.when(F.col("at").isNotNull(), at_depth("path", F.coalesce("at", F.lit(0)))), nodes, "handle")
        there = F.col("t_id").isNotNull()
        whole = there & (F.col("t_len") <= F.col("n")) & at_depth("path", F.least("t_len", "n")).eqNullSafe(F.col("t_id"))
        low = F.when(whole, F.col("t_len")).when(there, F.col("t_up")).otherwise(F.col("lo"))
        high = F.when(whole, F.col("hi")).when(there, F.col("t_up")).otherwise(F.coalesce(F.col("at") - 1, "hi"))
        found = found.select(*paths.columns, low.alias("lo"), high.alias("hi"))
    edges = trie.select(F.element_at("edge", 1).alias("first"), F.col("id").alias("exit_id"),
                        F.col("len").alias("exit_len"), F.col("edge").alias("exit_edge"))
    ahead = F.when(F.col("lo") < F.col("n"), at_depth("path", F.least(F.col("lo") + 1, F.col("n"))))
    found = _meet(found, ahead, edges, "first")
    shared = F.when(F.col("exit_id").isNull(), 0).otherwise(F.size(F.array_intersect("exit_edge", "path")))
    return found.select(*paths.columns, (F.col("lo") + shared).alias("lcp"), "exit_id", "exit_len")


# ---- insertion ----------------------------------------------------------------------------------------
def _split(trie: DataFrame, found: DataFrame) -> DataFrame:
    """The edges of the trie, cut where paths leave them. Cuts of a node are at most its edge's turns."""
    cuts = found.where("exit_id IS NOT NULL AND lcp < exit_len").groupBy(F.col("exit_id").alias("id")).agg(
        F.collect_set("lcp").alias("cuts"))
    rows = trie.join(cuts, "id", "left")
    ends = F.array_sort(F.array_append(F.coalesce("cuts", F.array().cast("array<int>")), F.col("len")))
    begins = F.concat(F.array("up"), F.slice("ends", 1, F.size("ends") - 1))
    rows = rows.withColumn("ends", ends).select("*", F.explode(F.arrays_zip(begins.alias("low"), F.col("ends").alias("high"))).alias("p"))
    before = (F.col("p.low") - F.col("up")).cast("int")
    return rows.select(
        F.element_at("edge", F.col("p.high") - F.col("up")).alias("id"), F.col("p.high").alias("len"), F.col("p.low").alias("up"),
        F.when(before == 0, F.col("up_id")).otherwise(F.element_at("edge", F.greatest(before, F.lit(1)))).alias("up_id"),
        F.slice("edge", before + 1, F.col("p.high") - F.col("p.low")).alias("edge"), "owner")


def _grown(found: DataFrame) -> DataFrame:
    """The edges that hang the paths' ends into the trie."""
    rows = found.where("lcp < n")
    tail = rows.select("seq", "n", "lcp", "path", F.explode(F.sequence(F.col("lcp") + 1, F.col("n"))).alias("d"))
    tail = tail.select("seq", "d", (F.col("d") == F.col("n")).alias("is_end"), (F.col("d") > F.col("lcp") + 1).alias("inner"),
                       at_depth("path", F.col("d")).alias("s"), at_depth("path", F.col("d") - 1).alias("q"))
    each = stored(tail.groupBy("s", "q").agg(
        F.min("seq").alias("owner"), F.max("is_end").alias("is_end"), F.max("inner").alias("inner")), "trie-prefixes")
    forks = each.where("inner").groupBy(F.col("q").alias("s")).agg(F.count(F.lit(1)).alias("kids")).where("kids > 1")
    marks = each.join(forks, "s", "left").where("is_end OR kids > 1").select("s", "owner", F.xxhash64("s").alias("_code"))
    cuts = tail.select("seq", "d", "s", F.xxhash64("s").alias("_code")).join(marks, ["s", "_code"]).groupBy("seq").agg(
        F.sort_array(F.collect_list(F.struct("d", (F.col("owner") == F.col("seq")).alias("own")))).alias("ends"))
    begins = F.concat(F.array("lcp"), F.col("ends.d"))
    pieces = F.arrays_zip(F.slice(begins, 1, F.size("ends")).alias("low"), F.col("ends.d").alias("high"), F.col("ends.own").alias("own"))
    out = rows.join(cuts, "seq").select("seq", "path", F.explode(pieces).alias("p")).where("p.own")
    return out.select(
        at_depth("path", F.col("p.high")).alias("id"), F.col("p.high").alias("len"), F.col("p.low").alias("up"),
        at_depth("path", F.col("p.low")).alias("up_id"),
        F.slice("path", F.col("p.low") + 2, F.col("p.high") - F.col("p.low")).alias("edge"), F.col("seq").alias("owner"))


def insert(trie: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The trie with a batch of distinct paths (seq, n, path) in it."""
    if trie is None:
        none = F.lit(None).cast(PREFIX)
        found = batch.withColumns({"lcp": F.lit(0), "exit_id": none, "exit_len": F.lit(None).cast("int")})
        return stored(_grown(found), "trie")
    found = stored(located(batch, trie), "trie-located")
    return stored(_split(trie, found).unionByName(_grown(found)), "trie")


def build(paths: DataFrame, batches: tuple[float, ...] = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(distinct paths with their smallest id and number, compacted trie without the root)."""
    end = at_depth("path", F.col("n"))
    ends = paths.groupBy("n", end.alias("end")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("k"))
    distinct = stored(paths.join(ends.select("conv_id", "end", "k"), "conv_id").withColumnRenamed("conv_id", "seq"), "trie-paths")
    place = F.pmod(F.xxhash64("seq"), F.lit(1 << 20)) / float(1 << 20)
    trie, before = None, 0.0
    for upto in batches:
        batch = distinct.where((place >= before) & (place < upto)).select("seq", "n", "path")
        trie, before = insert(trie, batch), upto
    return distinct, trie


# ---- numbers of the nodes -------------------------------------------------------------------------------
def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest per node from its lists in order; a node's lists may come in several batches."""
    key, code = None, None
    for batch in batches:
        out = []
        for a, b, c, ids in zip(batch["a"], batch["b"], batch["c"], batch["ids"], strict=True):
            if (a, b, c) != key:
                if key is not None:
                    out.append((*key, code.hexdigest()))
                key, code = (a, b, c), hashlib.sha256(ids.encode())
            else:
                code.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["a", "b", "c", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, code.hexdigest())], columns=["a", "b", "c", "ends_sha256"])


def end_digests(paths: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes where conversations end. Lists of ``ENDS`` consecutive ids meet
    in order of the ids, and the digest reads them one after the other."""
    rows = paths.select("conv_id", at_depth("path", F.col("n")).alias("end"), F.floor(F.col("conv_id") / ENDS).alias("block"))
    lists = rows.groupBy("end", "block").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    lists = lists.select("end.a", "end.b", "end.c", "block", "ids").repartition("a", "b", "c")
    lists = lists.sortWithinPartitions("a", "b", "c", "block")
    found = lists.mapInPandas(_hashed, "a long, b long, c long, ends_sha256 string")
    return found.select(F.struct("a", "b", "c").alias("id"), "ends_sha256")


def compacted(paths: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """One row per node of the compacted trie, the root included: the trie's columns, conv_id, n_convs,
    n_children, n_leaves, total and below (characters of the paths that end in the subtree, and of the
    nodes below this one), up_conv_id, ends_sha256."""
    distinct, trie = build(paths, batches)
    root = F.expr(f"cast(struct(0 AS a, 0 AS b, 0 AS c) AS {PREFIX})")
    kids = trie.groupBy(F.col("up_id").alias("id")).agg(F.count(F.lit(1)).alias("kids"))
    top = distinct.limit(1).select(
        root.alias("id"), F.lit(0).alias("len"), F.lit(-1).alias("up"), F.lit(None).cast(PREFIX).alias("up_id"),
        F.array().cast(f"array<{PREFIX}>").alias("edge"), F.lit(None).cast("long").alias("owner"))
    nodes = stored(trie.unionByName(top).join(kids, "id", "left"), "trie-nodes")
    leaves = nodes.where("kids IS NULL").select(F.col("id").alias("end"), F.lit(1).alias("leaf"))
    steps = distinct.join(leaves, "end", "left").select(
        "seq", "k", F.coalesce("leaf", F.lit(0)).alias("leaf"), (F.col("k") * F.col("end.c")).alias("chars"),
        F.posexplode("path").alias("d", "id")).withColumn("_code", F.xxhash64("id"))
    own = nodes.select("id", "owner", (F.col("id.c") - F.coalesce("up_id.c", F.lit(0))).alias("edge_chars"), F.xxhash64("id").alias("_code"))
    deeper = Window.partitionBy("seq").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, -1)
    passed = steps.join(own, ["id", "_code"]).withColumn("below", F.coalesce(
        F.sum(F.when(F.col("owner") == F.col("seq"), F.col("edge_chars")).otherwise(0)).over(deeper), F.lit(0)))
    sums = passed.groupBy("id").agg(
        F.sum("k").alias("n_convs"), F.min("seq").alias("conv_id"), F.sum("chars").alias("total"),
        F.sum("leaf").alias("n_leaves"), F.sum("below").alias("below"))
    nodes = stored(nodes.join(sums, "id").join(end_digests(paths), "id", "left"), "trie-sums")
    above = nodes.select(F.col("id").alias("up_id"), F.col("conv_id").alias("up_conv_id"), F.xxhash64("id").alias("_code"))
    rows = nodes.withColumn("_code", F.xxhash64("up_id"))
    return rows.join(above, ["up_id", "_code"], "left").drop("_code").withColumn("n_children", F.coalesce("kids", F.lit(0)).cast("long")).drop("kids")


def expanded(nodes: DataFrame) -> DataFrame:
    """One row per turn along every edge."""
    nothing = hashlib.sha256(b"").hexdigest()
    first = F.coalesce("up_id.c", F.lit(0))
    # Characters up to the turn before each turn of the edge; the root is one turn without any.
    before = F.when(F.col("len") == 0, F.array(F.lit(0).cast("long"))).otherwise(
        F.concat(F.array(first), F.slice("edge.c", 1, F.greatest(F.size("edge") - 1, F.lit(0)))))
    rows = nodes.select("*", F.posexplode(before).alias("i", "chars"))
    depth = F.col("up") + 1 + F.col("i")
    last = depth == F.col("len")
    saved = F.col("total") - F.col("n_convs") * F.col("chars") - (F.col("below") + F.col("id.c") - F.col("chars"))
    return rows.select(
        "conv_id", depth.cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("up_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("n_children")).otherwise(1).cast("long").alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(nothing))).otherwise(nothing).alias("ends_sha256"))


def nodes_of(conversations: DataFrame, batches: tuple[float, ...] = BATCHES) -> DataFrame:
    """All prefix nodes of the rebuilt conversations."""
    paths = stored(paths_of(rebuilt(turns_of(conversations))), "trie-conversations")
    return expanded(compacted(paths, batches))
