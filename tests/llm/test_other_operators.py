import base64
import collections
import datetime
import hashlib
import math
import random
import time
import tracemalloc
import zlib

import brute
import numpy as np
import pandas as pd
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import html_text, mixing, near_vectors, ngram, queries, url_filter, warc

SF = "/root/testdata/sf0.001"


# ---- near-duplicate vectors --------------------------------------------------------------------
VECS = "vec_id long, embedding array<float>, label int, n_links int, node string"


def vector_groups(rows, cosine=near_vectors.COSINE):
    good = {}
    for i, v, label, *_ in rows:
        if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.asarray(v, np.float32).astype(np.float64))
    ids = sorted(good)
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            (la, x), (lb, y) = good[a], good[b]
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                links.append((a, b))
    every = [r[0] for r in rows]
    found = brute.groups(every, links)
    count = {i: sum(i in p for p in links) for i in every}
    return {i: (count[i], found[i]) for i in every}


def vectors(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, 40))
    rows = []
    for i in range(n):
        c = centres[rng.integers(8)] if i % 3 else rng.standard_normal(40)
        v = c + rng.standard_normal(40) * rng.choice([0.05, 0.2, 0.3, 0.45])
        rows.append((i, [float(x) for x in v], int(rng.integers(3)), 0, "x"))
    for i in range(n, n + 30):  # copies of one vector
        rows.append((i, rows[1][1], rows[1][2], 0, "x"))
    odd = [None, [], [0.0] * 40, [float("nan")] * 40, [None] + [1.0] * 39, [float("inf")] * 40, [1.0, 2.0], [1.0, 2.1]]
    rows += [(1000 + k, v, 1, 0, "x") for k, v in enumerate(odd)]
    return rows + [(2000, rows[0][1], None, 0, "x"), (2001, rows[0][1], None, 0, "x")]


@pytest.mark.parametrize("tile", [4096, 16])
def test_vector_groups_equal_all_pairs(spark, tile):
    rows = vectors(3, 260)
    got = near_vectors.near_groups(spark.createDataFrame(rows, VECS), tile=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == vector_groups(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_without_id_and_none_at_all(spark):
    rows = [(None, [1.0, 0.0], 1, 0, "x"), (2, [1.0, 0.0], 1, 0, "x"), (2, [1.0, 0.0], 1, 0, "x")]
    got = {tuple(r) for r in near_vectors.near_groups(spark.createDataFrame(rows, VECS)).collect()}
    assert got == {(None, 0, None, True), (2, 0, 2, True)}
    assert near_vectors.near_groups(spark.createDataFrame([], VECS)).count() == 0


# ---- mixing -------------------------------------------------------------------------------------
def test_raking_meets_all_marginals(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 40)) + rng.choice(["", " | x", "!! x"]),
             rng.choice(["en", "en", "en", "de", None]), rng.choice(["src0", "src0", "src1", "z", None])) for i in range(600)]
    rows += [(None, None, None, None), (601, "", "en", "src0"), (601, "", "en", "src0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"src0": 0.2, "src1": 0.5, "other": 0.3}, "lang": {"en": 0.5, "de": 0.3, "other": 0.2},
               "topic": {"prose": 0.6, "table": 0.2, "shout": 0.2, "licence": 0.5}}
    cells = mixing.raked(mixing.celled(df, targets), targets, share=0.2)
    for k, d in enumerate(mixing.DIMENSIONS):
        there = {c[k] for c in cells}
        total = sum(targets[d].get(v, 0) for v in there)
        for v in there:
            assert abs(sum(c[4] for c in cells if c[k] == v) - targets[d].get(v, 0) / total) < 1e-6
    assert all(0 <= c[5] <= 1 for c in cells)
    assert sum(c[3] * c[5] for c in cells) == pytest.approx(0.2 * sum(c[3] for c in cells), rel=1e-6)
    mix = mixing.mixed(df, targets).collect()
    assert len(mix) == len(rows)
    assert {r.sampled for r in mix if r.doc_id == 601} in ({True}, {False})
    taken = mixing.sampled(df, targets)
    assert sorted(str(r.doc_id) for r in taken.collect()) == sorted(str(r.doc_id) for r in mix if r.sampled)
    assert mixing.mixed(df.limit(0), targets).count() == mixing.sampled(df.limit(0), targets).count() == 0


def test_bounded_cells_leave_their_tokens_to_others(spark):
    """On the documents several targets ask for more than there is: those values give all they have, all
    others meet their share of the rest, and the sample holds the wanted number of tokens."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    plan = mixing.raked(mixing.celled(docs))
    tokens = sum(r[3] for r in plan)
    assert sum(r[5] == 1.0 for r in plan) > 20 and all(0 <= r[5] <= 1 for r in plan)
    assert sum(r[3] * r[5] for r in plan) == pytest.approx(mixing.SHARE * tokens, rel=1e-6)
    found = mixing.marginals(plan)
    for _, value, wanted, goal, expected in found:
        assert expected == pytest.approx(goal, abs=1e-6 * tokens), value
    short = {v for _, v, wanted, goal, _ in found if goal < wanted - 1}
    assert short == {"licence", "shout"}


def test_feasible_goals():
    room, wanted = np.array([10.0, 100.0, 5.0, 50.0]), np.array([0.25, 0.25, 0.25, 0.25])
    assert mixing.feasible(room, wanted, 80.0).tolist() == [10.0, 32.5, 5.0, 32.5]
    assert mixing.feasible(room, wanted, 160.0).tolist() == [10.0, 95.0, 5.0, 50.0]


# ---- language model ---------------------------------------------------------------------------
def plain_base(docs):
    from binascii import crc32
    from collections import Counter

    tokens = {k: (t or "").encode().lower().split() + [None] for k, t in docs.items()}
    held = {k: crc32(str(k).encode()) % 7 == 2 for k in docs}
    c = Counter(t for k in docs if not held[k] for t in tokens[k])
    n, v = sum(c.values()), len(c)
    return {k: (held[k], len(ts), sum(c[t] > 0 for t in ts), n,
                sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)) for k, ts in tokens.items()}


def plain_scores(docs, rounds=ngram.EM_ROUNDS):
    """Deleted interpolation by dictionaries of n-grams."""
    grams = {}
    for k, text in docs.items():
        w = [1, 1, *((text or "").encode().lower().split()), 2]
        grams[k] = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    fold = {k: zlib.crc32(str(k).encode()) % 7 for k in docs}

    def counts(some):
        one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
        for k in some:
            for a, b, w in grams[k]:
                one[w] += 1
                two[b, w] += 1
                three[a, b, w] += 1
        return one, two, three

    def parts(gram, found):
        (a, b, w), (one, two, three) = gram, found
        texts, n, v = one[2], sum(one.values()), len(one)
        x2 = texts if b == 1 else one[b]
        x3 = texts if a == b == 1 else two[a, b]
        bucket = 64 + int(math.log2(x3)) if x3 else int(math.log2(x2)) if x2 else -1
        return bucket, [three[gram] / x3 if x3 else 0, two[b, w] / x2 if x2 else 0, one[w] / max(n, 1), 1 / (v + 1)]

    kept = counts([k for k in docs if fold[k] not in (2, 3)])
    tokens = sum(kept[0].values())
    held = collections.Counter()
    for k in docs:
        if fold[k] == 3:
            for g in grams[k]:
                bucket, e = parts(g, kept)
                held[bucket, tuple(e)] += 1
    weights = {b: ngram.settled(np.full(4, 0.25), ngram.allowed(b, tokens)) for b, _ in held}
    for _ in range(rounds):
        sums = {b: np.zeros(4) for b in weights}
        for (b, e), n in held.items():
            share = weights[b] * np.array(e)
            sums[b] += n * share / share.sum()
        weights = {b: ngram.settled(s / s.sum(), ngram.allowed(b, tokens)) for b, s in sums.items()}
    full = counts([k for k in docs if fold[k] != 2])
    out = {}
    for k in docs:
        total = 0.0
        for g in grams[k]:
            b, e = parts(g, full)
            w = weights.get(b)
            w = ngram.settled(np.full(4, 0.25), ngram.allowed(b, sum(full[0].values()))) if w is None else w
            total += math.log10(float(w @ np.array(e)))
        out[k] = total
    return out


def test_a_piece_is_scored_in_little_memory(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in rng.integers(0, 400, 120_000)]
    texts = [" ".join(words[k:k + 300]).encode() for k in range(0, len(words), 300)]
    piece = pd.DataFrame({"piece": [1], "ids": [list(range(len(texts)))], "lengths": [[len(t) for t in texts]],
                          "blob": [zstandard.compress(b"".join(texts))]})
    asked = pd.concat([a.assign(part=0) for a in ngram._asked(2)([piece.assign(part=0)])])
    answers = pd.concat([ngram._answered(a) for _, a in asked.groupby("bucket")])
    answers = answers[answers["piece"].notna()]
    weights = {k: np.array([0.4, 0.3, 0.2, 0.1]) for k in range(128)}
    whole = ngram._scored(2, weights, 120_400, 401)(piece, answers)
    monkeypatch.setattr(ngram, "SLICE", 1000)
    tracemalloc.start()
    again = ngram._scored(2, weights, 120_400, 401)(piece, answers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pd.testing.assert_frame_equal(whole, again)
    assert peak < 100 * 120_400  # about a dozen numbers a token


@pytest.mark.parametrize("keys, piece", [(ngram.KEYS, ngram.PIECE), (3000, 20000)])
def test_scores_equal_deleted_interpolation(spark, monkeypatch, keys, piece):
    monkeypatch.setattr(ngram, "PIECE", piece)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs = {r.doc_id: r.text for r in rows} | {900: None, 901: "", 902: "É É é \t a", 903: "word " * 30000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in ngram.score(df, keys=keys).collect()}
    want, scores = plain_base(docs), plain_scores(docs)
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[k][:4]
        assert r.base_score == pytest.approx(want[k][4], rel=1e-9, abs=1e-6)
        assert r.score == pytest.approx(scores[k], rel=1e-9, abs=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_keys_survive_packing():
    rng = np.random.default_rng(4)
    for keys in ([0], [2**48 - 1], [1, 2, 3], rng.integers(0, 1 << 48, 5000), np.arange(70000)):
        keys = np.unique(np.array(keys, np.uint64))
        assert (ngram.unpacked(ngram.packed(keys)) == keys).all()


def test_counts_survive_a_byte_each():
    for numbers in ([0], [254, 255, 256], [1, 10**12, 0, 255], range(600)):
        assert ngram.full(ngram.short(np.array(numbers))).tolist() == list(numbers)


def test_words_of_a_piece():
    """Words part at ASCII white space only, A-Z alone are lowered, and every text has one end."""
    texts = ["", " \t a  B\x0bc\x0cd\r\n", "\x1ca\u00a0b \u00c4A", "b A", "   "]
    data = [t.encode() for t in texts]
    one, sizes = ngram.words_of([len(t) for t in data], zstandard.compress(b"".join(data)))
    words = [w for t in data for w in [*t.lower().split(), None]]
    assert sizes.tolist() == [len(t.split()) + 1 for t in data]
    assert one.tolist() == [int(ngram.END) if w is None else xxhash.xxh64_intdigest(w) for w in words]


def test_rare_word_pairs_are_told_apart(spark):
    """A pair that was seen scores better than two words as frequent that never met."""
    docs = {i: "new york is big" if i % 2 else "red fork is old" for i in range(200)}
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    docs |= dict(zip(held, ["new york", "red fork", "new fork", "red york"]))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: r.score for r in ngram.score(df).collect()}
    seen, unseen = [got[i] for i in held[:2]], [got[i] for i in held[2:]]
    assert min(seen) > max(unseen) + 0.5


def test_language_model_of_few_rows(spark):
    empty = ngram.score(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    rows = [(None, "a b"), (5, "a b"), (5, None)]
    got = {r.doc_id: r for r in ngram.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5].n_tokens == 4 and got[None].n_tokens == 3 and not got[None].held_out


# ---- URL filters ---------------------------------------------------------------------------------
def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


def test_lists_as_of_the_fetch_day(spark):
    entries = [
        ("d:bad.org", "block", day(10), True), ("d:bad.org", "block", day(20), False), ("d:bad.org", "block", day(30), True),
        ("d:x.bad.org", "allow", day(15), True), ("p:bad.org/good/", "allow", day(0), True),
        ("p:bad.org/good/not/", "block", day(0), True), ("d:tie.org", "allow", day(5), True), ("d:tie.org", "block", day(5), True),
        ("d:gone.org", "block", day(5), True), ("d:gone.org", "block", day(5), False),
        (None, "block", day(0), True), ("d:bad.org", None, day(0), True), ("d:nodate.org", "block", None, True),
    ]
    cases = [
        ("http://bad.org/", 9, "none"), ("http://bad.org/", 10, "block"), ("http://a.b.BAD.org:80/q?x#y", 19, "block"),
        ("http://bad.org/", 20, "none"), ("http://bad.org/", 30, "block"), ("http://x.bad.org/", 14, "block"),
        ("http://x.bad.org/", 15, "allow"), ("https://u@bad.org/good/page", 12, "allow"), ("https://bad.org/good", 12, "block"),
        ("https://bad.org/good/not/page", 12, "block"), ("http://notbad.org/", 12, "none"), ("http://tie.org", 6, "allow"),
        ("http://gone.org", 6, "none"), ("http://nodate.org", 6, "none"), ("no url", 6, "none"), (None, 6, "none"), ("http://bad.org/", None, "none"),
        ("http://bad.org/", 10, "block"),
    ]
    rows = [(i, u, None if n is None else day(n), "mine") for i, (u, n, _) in enumerate(cases)]
    caps = spark.createDataFrame(rows, "page_id long, url string, fetched date, rank string")
    listed = spark.createDataFrame(entries, "pattern string, verdict string, day date, added boolean")
    got = {r.page_id: r.verdict for r in url_filter.judge(caps, listed).collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(cases)}
    assert {r.verdict for r in url_filter.judge(caps, listed.limit(0)).collect()} == {"none"}
    assert url_filter.judge(caps.limit(0), listed).count() == 0


# ---- main text of pages ------------------------------------------------------------------------
def page(body, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body>"
            f"<header class=top><p>Site name</p></header><nav><ul><li><a href=/>Home<li><a href=/b>B</ul></nav>"
            f"<div class='cookie-notice'>We use cookies</div>{body}<aside>Side</aside>{extra}"
            f"<form><p>Search</p></form><div id=comments><p>First!</p></div><footer>&copy; me</footer></body></html>")


ARTICLE = "<article><h1>A &amp; B</h1><p>One <b>two</b>\n three<br>four<p>five&nbsp;&#8364; <!-- x --><div class='ad'>buy</div><ul><li>six<li>seven</ul></article>"
PLAIN = "<div class=box><p>{0} first text that differs</p><p>{0} second text</p></div><p>same on every page</p>"


def test_main_text(spark):
    rows = [(1, "http://a.org/1", page(ARTICLE)), (2, "http://a.org/2", page("<article></article>")),
            (3, "http://a.org/3", None), (4, None, "just text"), (5, "http://b.org", page(ARTICLE)[:430]),
            (1, "http://a.org/1", page(ARTICLE)), (None, "bad url", "<p>x < y</p>")]
    rows += [(10 + k, f"http://c.org/{k}", page(PLAIN.format("abc"[k]))) for k in range(3)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_text.extract(df).collect()]
    text = "A & B\nOne two three four\nfive €\nsix\nseven"
    assert got.count((1, text)) == 2 and (2, "") in got and (3, "") in got and (4, "just text") in got
    assert (None, "x < y") in got and (11, "b first text that differs\nb second text") in got
    assert len(got) == len(rows)
    assert html_text.extract(df.limit(0)).count() == 0


def main_texts(spark, pages):
    df = spark.createDataFrame([(k, "http://h.org/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html_text.extract(df).collect())]


@pytest.mark.parametrize("html,text", [
    ("<html><head><meta charset=x><title>t</title><body><article><p>Text", "Text"),
    ("<head><title>t</title>Text", "Text"),
    ("<body><form id=f><main><p>Text</main></form>", "Text"),
    ("<body><form id=f><nav>menu</nav><div><p>Text</p></div><footer>foot</footer></form>", "Text"),
    ("<body><form id=f><p>Search</p></form>", ""),
    ("<article><p>Text</p><form><p>Subscribe</form></article>", "Text"),
    ("<article><p>Let <math><msup><mi>x</mi><mn>2</mn></msup><annotation>x^2</annotation></math> be", "Let x2 be"),
])
def test_left_out_tags_forms_and_formulas(spark, html, text):
    blocks = html_text.blocks_of(html)
    assert "\n".join(b[3] for b in blocks if not b[1]) == text
    assert main_texts(spark, [html, None]) == [text, ""]


def test_deep_nesting_costs_no_more_than_its_length():
    began = time.monotonic()
    for end in ("", "</div>" * 60_000, "</p></a>" * 60_000):
        blocks = html_text.blocks_of("<div>" * 60_000 + "<p>Text <a>link</a>" + end)
        assert [b[3:] for b in blocks] == [("Text link", 4)] and len(blocks[0][0]) < 2 * html_text.LONG_PATH
    assert time.monotonic() - began < 20
    deep = ["<article>" + "<div>" * 3000 + f"<p>{x}</p>" + "</div>" * 3000 + "</article>" for x in "ab"]
    assert [[b[3] for b in html_text.blocks_of(d)] for d in deep] == [["a"], ["b"]]
    assert html_text.blocks_of(deep[0])[0][0] == html_text.blocks_of(deep[1])[0][0]


def test_one_page_with_an_article_does_not_decide_for_a_host(spark):
    plain = [page(PLAIN.format(x)) for x in "abc"]
    got = main_texts(spark, [*plain, page(ARTICLE + "<p>same on every page</p>")])
    assert got[1] == "b first text that differs\nb second text" and got[3].endswith("six\nseven")
    both = [page(f"<article><p>{x}</p></article><p>around</p>") for x in "ab"]
    assert main_texts(spark, [*both, page("<article></article><p>around</p>")]) == ["a", "b", ""]


def test_bodies_with_one_opening_and_copies_are_main_text(spark):
    opening = "the same opening " * 20
    pages = [f"<div class=box>{opening}{x}</div><p>date {x}</p><div class=foot>footing</div>" for x in "abc"]
    assert main_texts(spark, pages) == [f"{opening}{x}\ndate {x}" for x in "abc"]
    copies = [f"<div class=box>{opening}</div><p>date {x}</p>" for x in "abc"]
    assert main_texts(spark, copies) == [f"{opening.strip()}\ndate {x}" for x in "abc"]


def test_layout_names_do_not_exclude_articles(spark):
    body = "<article><header class='entry-header'><h1>Title</h1></header><p>Text</p><div class=ad>buy</div></article>"
    for around in ("page has-sidebar", "site-header", "search"):
        assert main_texts(spark, [f"<div class='{around}'>{body}<p class='cookie-notice'>we</p></div>"]) == ["Title\nText"]
    assert main_texts(spark, [f"<p>x</p><div id=comments>{body}</div>"]) == ["x"]
    assert main_texts(spark, [f"<div class=header-image><p>x</p></div><aside>{body}</aside>"]) == ["x"]


def test_wrappers_fold_and_align():
    one, two = ([(p, False, False, p + x, 0) for p in ps] for ps, x in (("hppf", "1"), ("hpnpnpf", "2")))
    w = html_text.aligned(html_text.page_wrapper(one), html_text.page_wrapper(two))
    assert html_text.expression(w).split()[0] == "h" and html_text.expression(w).split()[-1] == "f"
    assert html_text.expression(html_text.page_wrapper(two)) == "h p+ n+ p f"


def test_pages_query(spark):
    import re
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op9_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.split(r"</article>|<footer", re.split("<article>", pages[r.page_id])[1])[0] if "<article>" in pages[r.page_id] else ""
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"</?b>|<br>|<[^>]*$", " ", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


# ---- archives ------------------------------------------------------------------------------------
def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archive_round_trip(spark):
    rows = [(1, "http://a/é\r\nX: y", "<p>ü</p>"), (2, "http://b", "<p>ü</p>"), (3, None, None), (4, "http://d", ""),
            (5, "http://e", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (5, "http://e", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (6, "http://f", "x" * 300000),
            (None, "http://g", "n"), (None, "http://h", "<p>ü</p>")]
    df = spark.createDataFrame([(*r, "a") for r in rows], "page_id long, url string, html string, archive string")
    index = warc.write(df)
    got = sorted(((r.page_id or 0, r.url or "", r.record_type, r.refers_to, r.payload_bytes, r.payload_digest,
                   None if r.payload is None else bytes(r.payload), r.intact) for r in warc.read(index).collect()), key=str)
    tops = {}
    for i, _, h in rows:
        tops[h or ""] = max(tops.get(h or "", -1), i if i is not None else -1)
    want = []
    for i, u, h in rows:
        data, top = (h or "").encode(), tops[h or ""]
        again = top >= 0 and (i is None or i < top)
        want.append((i or 0, u or "", "revisit" if again else "response", top if again else None, len(data), sha1(data),
                     None if again else data, True))
    assert got == sorted(want, key=str)
    some = warc.read(index.where("page_id = 6")).collect()
    assert [r.payload_bytes for r in some] == [300000]
    assert warc.read(warc.write(df.limit(0))).count() == 0


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.read(warc.write(df, min_bytes=3)).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_ranges_are_joined():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 30 + warc.GAP, 5), ("b", 0, 5), ("b", 5, warc.RANGE), ("b", 5 + warc.RANGE, 5)]
    assert [(a, b, e, k) for a, b, e, k in warc.ranges(rows)] == [
        ("a", 0, 20, [0, 1]), ("a", 30 + warc.GAP, 35 + warc.GAP, [2]), ("b", 0, 5, [3]), ("b", 5, 5 + warc.RANGE, [4]),
        ("b", 5 + warc.RANGE, 10 + warc.RANGE, [5])]
