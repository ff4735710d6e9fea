import random
import zlib
from collections import Counter

import duckdb
import pytest

from tidemark.llm import queries, spelling
from tidemark.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n string, root int"
ALPHABET = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", "n", 1) for i, t in rows], DOCS)


def plain(rows):
    """word -> (n, n_near, form, form_n, root), by generating every edit of every word."""
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
            run = ""
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out, form = {}, {}
    for w, n in words.items():
        edits = {w[:i] + w[i + 1:] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + k:] for i in range(len(w) + 1) for c in ALPHABET for k in (0, 1)}
        near = [x for x in edits - {w} if x in words]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out[w] = (n, len(near), form[w], words.get(form[w]))
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def found(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def corpus(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé÷ß") for _ in range(rng.randint(4, 8))) for _ in range(40)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems[:1 + int(40 * rng.random() ** 2)])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abÿz") + w[k:], w[:k] + "b" + w[k + 1:]])
            words.append(w.upper() if rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", "-", "7", "你", "_"]).join(words)))
    return rows


ODD = [(None, "straße straße straße"), (None, None), (900, None), (901, ""), (902, "1234 !?"), (903, "abcde " * 5),
       (903, "abcde " * 5), (904, "x" * 3000), (904, "x" * 3000), (905, "x" * 3000 + " " + "x" * 2999), (906, "aaaaab " * 40000),
       (907, "ÀÉabc Àéabc àéabc " * 3), (908, "Ā" + "hello" + "ſ world"), (909, "hello hello world world wÖrld wÖrld wÖrld")]


@pytest.mark.parametrize("blocks", [spelling.ROUND_BLOCKS, 7])
def test_same_variants_as_every_edit_of_every_word(spark, blocks):
    rows = corpus(3) + ODD
    got = found(spelling.variants(frame(spark, rows), blocks))
    assert got == plain(rows) and len(got) > 100
    assert any(v[4] != v[2] and v[2] for v in got.values())


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    text = "alpha beta gamma " * 500 + "delta" * 3000 + " omega " * 3
    monkeypatch.setattr(spelling, "PIECE", 64)
    assert [w for part in spelling.slices(text) for w in part.split()] == [w.encode() for w in text.split()]


def test_no_words(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, "a bb ccc")])).count() == 0


def test_every_edit_passes_its_filter():
    """The hash of an edit equals the hash of the word it gives."""
    words = ["abcde", "éabcd", "zzzzz"]
    shards = spelling.Shards({4: (0, 9), 5: (9, 9)}, {4: 2, 5: 2}, 18, spelling.np.frombuffer(b"abcdez", "u1"))
    (_, _, codes), = spelling._by_size(spelling.pd.Series(words, dtype=object))
    seen = 0
    for size, i, of, new, h in spelling._edits(codes, shards):
        for w, c, x in zip(of, new, h, strict=True):
            edit = words[w][:i] + (chr(c) if c else "") + words[w][i + 1:]
            assert len(edit) == size
            (_, _, own), = spelling._by_size(spelling.pd.Series([edit], dtype=object))
            assert spelling._hashes(own)[0] == x
            seen += 1
    assert seen > 40


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    wanted = {r[0]: r[1:] for r in con.sql(
        f"SELECT word, n, n_near, form, form_n, root FROM ({ORACLES['op12_spelling']})").fetchall()}
    assert found(queries.op12_spelling(spark, SF)) == wanted
