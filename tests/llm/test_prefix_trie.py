import hashlib
import math
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie, queries
from tidemark.llm.oracles import ORACLES

CONVS = "conv_id long, turn long, role string, text string, id string, n int, path string, k long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", 1, "p", 5) for r in rows], CONVS)


def plain(rows):
    """All nodes, by a dictionary of prefixes. Turns of equal number must be equal here."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in own) or 1
        saved[p] = sum(saved[k] for k in own) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        if p:
            kids.setdefault(p[:-1], []).append(p)
    return sorted((
        min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids.get(p, [])), leaves[p], saved[p],
        hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p)))).encode()).hexdigest())
        for p, m in members.items())


def found(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).fillna(-1, ["parent_conv_id"]).collect())


def corpus(seed, convs=250, depth=9):
    """Few different turns, so paths share beginnings, and groups of copies."""
    rng, rows, copies = random.Random(seed), [], []
    for c in range(convs):
        c = c * 7 + 3 if c % 3 else c * 100
        own = [(rng.choice(["user", "assistant"]), rng.choice("abc") * rng.randint(1, 2)) for _ in range(rng.randint(1, depth))]
        own = rng.choice(copies) if copies and rng.random() < 0.4 else own
        copies.append(own)
        rows += [(c, k, *t) for k, t in enumerate(own)]
    return rows


ODD = [(None, 1, "user", "x"), (50000, None, "user", "late"), (50000, 3, None, None), (50000, 4, "", ""), (50001, 7, "user", ""),
       (50002, None, None, None), (50002, None, None, None), (50003, 1, "user", "a"), (50003, 1, "user", "a"), (-250, 1, "user", "a"),
       (-200, 0, "user", "b"), (-200, 1, "user", "c"), (50004, 0, "user", "w" * 300000), (50005, 0, "us", "era"), (50006, 0, "use", "ra")]
LONG = [(c, k, "user", "t" if k != c - 9000 else f"other {c}") for c in range(9100, 9400, 37) for k in range(c - 8800)]


@pytest.mark.parametrize("batches", [(1.0,), prefix_trie.BATCHES, (0.1, 0.2, 0.3, 0.6, 1.0)])
def test_same_nodes_as_a_dictionary_of_prefixes(spark, batches):
    rows = corpus(len(batches)) + ODD + LONG
    got = found(prefix_trie.nodes_of(frame(spark, rows), batches))
    assert got == plain(rows) and len(got) > 500


def test_turnless_and_empty(spark):
    assert prefix_trie.nodes_of(frame(spark, [])).count() == 0
    assert prefix_trie.nodes_of(frame(spark, [(None, 1, "user", "a")])).count() == 0
    c = next(i for i in range(101, 200) if zlib.crc32(str(i).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone"), (c + 1000, 0, "user", "x")]
    assert found(prefix_trie.nodes_of(frame(spark, rows[:1]))) == plain(rows[:1])
    assert found(prefix_trie.nodes_of(frame(spark, rows))) == plain(rows)


def test_rows_in_any_order_and_long_lists_of_ends(spark, monkeypatch):
    """Many copies end at one node, their list spans several blocks and batches."""
    rows = [(c, 0, "user", "same") for c in range(0, 90000, 100)] + [(c, 0, "user", "own") for c in range(50, 90000, 900)]
    random.Random(1).shuffle(rows)
    monkeypatch.setattr(prefix_trie, "ENDS", 256)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(prefix_trie.nodes_of(frame(spark, rows))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_fattest(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a int, b int").withColumn("f", prefix_trie.fattest(F.col("a"), F.col("b")))
    for a, b, f in df.collect():
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_search_finds_where_every_path_leaves_the_trie(spark):
    rows = corpus(5, convs=120)
    paths = prefix_trie.paths_of(prefix_trie.turns_of(frame(spark, rows))).cache()
    distinct, _ = prefix_trie.build(paths)
    part = F.col("seq") % 2 == 0
    trie = prefix_trie.insert(None, distinct.where(part).select("seq", "n", "path"))
    held = {tuple(map(tuple, r.path[:d])) for r in distinct.where(part).collect() for d in range(len(r.path) + 1)}
    asked = prefix_trie.located(distinct.where(~part).select("seq", "n", "path"), trie).collect()
    assert asked
    for r in asked:
        path = tuple(map(tuple, r.path))
        assert r.lcp == max(d for d in range(r.n + 1) if path[:d + 1] in held)


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rows = con.sql(ORACLES["op11_prefix_trie"]).select(", ".join(COLUMNS)).fetchall()
    assert found(queries.op11_prefix_trie(spark, sf)) == sorted(tuple(-1 if x is None else x for x in r) for r in rows)
