import random

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_text, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, words string"


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "src0", len(t or ""), 1.0, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n", "one", "a b c d", "a b c d", "É ß ñ 你好 " * 30, "word " * 4000]


# ---- personal data ------------------------------------------------------------------------
PII = [
    "mail me: a.b@c.d.e, x@y, @z.com a@b.c_d@e.f", "é1.2.3.4.5.6.7.8 256.1.1.1 010.0.00.255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111222", "call +1 (743) 555-3824) or +12345",
    "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "my SSN 123-45-6789", "123-45-6789",
    "1 " * 9000, "a" * 20000 + "@", "a@" + "b." * 9000 + "c", "😀 +44 20 7946 0958 😀 x@y.zz",
]


def test_base_spans_equal_the_expressions(spark):
    texts = ODD + PII
    rows = pii.find(frame(spark, texts)).collect()
    for r in rows:
        got = [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE_KINDS]
        assert got == brute.base_spans(texts[r.doc_id]), texts[r.doc_id][:60]


def test_checksums_and_context(spark):
    spans = {r.doc_id: r.spans for r in pii.find(frame(spark, PII)).collect()}
    assert [(s.kind, s.text) for s in spans[4] if s.kind == "iban"] == [("iban", "GB82 WEST 1234 5698 7654 32")]
    assert [s.kind for s in spans[5]] == ["ssn"] and spans[6] == []
    card = [s for s in spans[2] if s.kind == "card"]
    assert [s.text for s in card] == ["4111 1111 1111 1111"] and card[0].score == 0.9


def test_masking(spark):
    df = frame(spark, ["x a@b.cc y +1 (743) 555-3824.", "none", None, "1.2.3.4@5.6 z"])
    out = df.select("doc_id", pii.masked(F.col("text"), pii.spans_of(F.col("text"))).alias("t")).collect()
    assert [r.t for r in sorted(out)] == ["x [EMAIL] y [PHONE].", "none", None, "[EMAIL] z"]


def test_many_matches_in_one_text(spark):
    text = "é " + " ".join(f"mail u{i}@x{i}.org or {i % 256}.2.3.4" for i in range(20_000))
    df = frame(spark, [text])
    spans = pii.find(df).first().spans
    assert [(s.kind, s.start, s.end) for s in spans if s.kind in pii.BASE_KINDS] == brute.base_spans(text)
    assert {s.score for s in spans if s.kind == "email"} == {0.9}
    got = df.select(pii.masked(F.col("text"), pii.spans_of(F.col("text"))).alias("t")).first().t
    assert got == "é " + " ".join(["mail [EMAIL] or [IP]"] * 20_000)


def test_context_across_blocks_and_empty_tables(spark):
    texts = ["x" * n + " contact a@b.cc" for n in range(pii.BLOCK - 20, pii.BLOCK + 3)]
    texts += ["y" * n + " a@b.cc " + "z" * (pii.NEAR - 9) + " contact" for n in (0, pii.BLOCK - 10, pii.BLOCK - 8)]
    assert {s.score for r in pii.find(frame(spark, texts)).collect() for s in r.spans} == {0.9}
    far = frame(spark, ["contact" + " " * (pii.NEAR + 1) + "a@b.cc"])
    assert pii.find(far).first().spans[0].score == 0.6
    wide = frame(spark, []).selectExpr("doc_id", "text", "1 spans", "2 kind")
    assert pii.find(wide).columns == ["doc_id", "spans"] and pii.find(wide).count() == 0


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op1_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute.base_spans(texts[r.doc_id])
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(k == kind for k, _, _ in base) for kind in brute.BASE)


# ---- near duplicates ------------------------------------------------------------------------
def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, base, share):
    return [f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in base]


def hard_texts():
    """A large group of copies edited to all degrees, so that many pairs lie on both sides of the
    threshold, small groups, exact copies, texts shorter than a shingle, and odd ones."""
    rng = random.Random(5)
    base = words(rng, 120)
    texts = [" ".join(edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05, 0.08]))) for _ in range(150)]
    for _ in range(30):
        own = words(rng, rng.randrange(3, 60))
        texts += [" ".join(edited(rng, own, 0.02)) for _ in range(rng.randrange(1, 5))]
    texts += [" ".join(base)] * 20 + ["A b C d", "a B c D"]
    rng.shuffle(texts)
    return texts + ODD


def test_near_groups_equal_all_pairs(spark):
    texts = hard_texts()
    rows = near_text.near_groups(frame(spark, texts)).collect()
    want = brute.near_groups(dict(enumerate(texts)))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_groups_with_missing_and_repeated_ids(spark):
    t = "one two three four five six seven eight"
    other = "a completely different text with other words in it"
    rows = [(None, t), (5, t), (3, t), (7, other), (7, t), (9, other), (9, other), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in near_text.near_groups(df).collect()}
    assert got == {None: (None, True), 3: (3, True), 5: (3, False), 7: (3, False), 9: (3, False)}


def test_prefixes_of_repeated_rows_hold_each_token_once(spark):
    """Two sets of 100 that share 86 shingles; the rarest of each are its own."""
    own = [[f"{s}{i}" for i in range(14)] for s in "ab"]
    shared = [f"w{i}" for i in range(90)]
    texts = [" ".join(o + shared) for o in own]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 4, "doc_id long, text string")
    reps = near_text.fingerprints(docs).select("doc_id", "set_key").distinct()
    sets = near_text.shingle_sets(docs, reps)
    assert sorted(r.doc_id for r in sets.collect()) == [0, 1]
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, label long")
    assert [tuple(r) for r in near_text.prefix_pairs(sets, labels).collect()] == [(0, 1)]


def test_near_groups_of_nothing(spark):
    assert near_text.near_groups(frame(spark, [])).count() == 0


def test_near_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_near_text(spark, SF).collect()}
    assert got == brute.near_groups(texts)


# ---- benchmark decontamination -----------------------------------------------------------------
ITEMS = {
    1: "The quick brown fox jumps over the lazy dog and then it sleeps a while",
    2: "short item", 3: "a a a a a a a a a a a a", 4: None, 5: "...", 6: "Short ITEM!", 7: "solo",
    8: "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10",
}
TEXTS = [
    "well, THE QUICK brown-fox jumps over the lazy dog and then it slept", "a " * 30, "a short item here",
    "x1 x2 x3 x4 x5 x6 x7 x8 x9", "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10", "solo solo", "itemshort item short item",
    "quick brown fox jumps over the lazy dog and then it sleeps a while", "x0 x1 x2 x3 x4 x5 x6 x7 x8 x9 x10 x11",
]


@pytest.mark.parametrize("sent", [0, decontaminate.SENT_SHINGLES])
@pytest.mark.parametrize("texts,items", [(TEXTS + ODD, ITEMS), ([], ITEMS), (TEXTS, {}), (TEXTS, {4: None})])
def test_hits_equal_windows_tried_everywhere(spark, monkeypatch, texts, items, sent):
    monkeypatch.setattr(decontaminate, "SENT_SHINGLES", sent)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontaminate.decontaminated(frame(spark, texts), bench).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids), brute.sha(",".join(r.item_ids))) for r in rows}
    assert got == brute.leaks(dict(enumerate(texts)), items)


@pytest.mark.parametrize("sent", [0, decontaminate.SENT_SHINGLES])
def test_repeated_rows_and_shared_ids_are_one_document(spark, monkeypatch, sent):
    monkeypatch.setattr(decontaminate, "SENT_SHINGLES", sent)
    bench = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    docs = spark.createDataFrame([(1, TEXTS[0]), (1, TEXTS[0]), (1, "so solo solo"), (None, TEXTS[4]), (2, "-")],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.decontaminated(docs, bench).collect()}
    alone = decontaminate.decontaminated(frame(spark, TEXTS[:1]), bench).first()
    # Positions 1 and 2 of the second text are added to those of the first unless already hit there.
    places = {*range(1, 1 + alone.n_hit), 1, 2}
    assert got == {1: (alone.n_words, len(places), [*alone.item_ids, "7"]), None: (10, 0, []), 2: (0, 0, [])}


def test_hits_of_long_texts_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SENT_SHINGLES", 0)
    rng = random.Random(8)
    texts = [" ".join(words(rng, 4000)) for _ in range(8)]
    items = {i: " ".join(t.split()[1000 * i:1000 * i + 14]) for i, t in enumerate(texts[:4])}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = decontaminate.decontaminated(frame(spark, texts), bench).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids), brute.sha(",".join(r.item_ids))) for r in rows}
    assert got == brute.leaks(dict(enumerate(texts)), items)


# ---- toxicity -----------------------------------------------------------------------------------
def test_toxicity_learns_insults_and_not_groups(spark):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(400):
        w = words(rng, 30)
        if i % 4 == 0:
            w.insert(7, rng.choice(["idiot", "moron"]))
            w.insert(9, "muslims")  # a group that toxic rows happen to name
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0), 1))
    docs = frame(spark, texts)
    table = spark.createDataFrame([*labels, (9999, 1, 1), (None, 1, 1), (4, None, 0)], "doc_id long, toxic int, quality int")
    free, tied = (toxicity.fit(docs, table, swap=s) for s in (0.0, 1000.0))
    assert free.weights["muslims"] > 0.5
    spread = [tied.weights[w] for w in ("muslims", "christians", "jews")]
    assert max(spread) - min(spread) < 0.25 * free.weights["muslims"]
    probe = frame(spark, ["you idiot", "muslims live here", None, ""], 1000)
    scores = [r.s for r in probe.select(toxicity.score(F.col("text"), tied).alias("s")).collect()]
    assert scores[0] > 0.5 and scores[1] < 0.5 and scores[2] == scores[3] < 0.5


def test_toxicity_keeps_every_word_that_tells(spark):
    insults = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}xqz" for k in range(300)]
    texts = [f"one two {insults[i // 3 % 300] if i % 3 == 0 else 'three'}" for i in range(13_500)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, texts), labels)
    assert sum(w in model.weights for w in insults) > 256  # those with enough rows outside the held-out fold
    assert all(model.score({w}) > 0.5 for w in insults) and model.score({"one", "three"}) < 0.5
    for text in ("les femmes rient", "die frauen lachen", "las mujeres cantan"):
        assert toxicity.counterfactuals(text)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, ODD), none)
    assert toxicity.Model(model.bias, model.weights).score({"idiot"}) < 0.5


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_query_of_odd_rows(spark, tmp_path):
    rows = [(None, None), (None, "plain words"), (1, ""), (7, "same"), (7, "same"), (9, "long " * 50000)]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, toxic string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels = spark.createDataFrame([(1, 0, 0), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for part in "ab":
        labels.write.parquet(f"{tmp_path}/{part}/labels.parquet")
    got = queries.op2_toxicity(spark, f"{tmp_path}/a").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert queries.op2_toxicity(spark, f"{tmp_path}/b").count() == 0
