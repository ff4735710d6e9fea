import math
import zlib
from collections import Counter, defaultdict

import pytest

from tidemark.llm import language, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, lang string, text string, shares int, score string, held_out int"
TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then the other things that were there",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann die anderen sachen",
    "es": "el rápido zorro marrón salta sobre el perro perezoso y luego las otras cosas que había",
}


def frame(spark, rows):
    """rows: (doc_id, lang, text)"""
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], DOCS)


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    row = "\0" + "\0".join(words) + "\0" if words else ""
    return Counter(row[i:i + 3] for i in range(len(row) - 2) if row[i + 1] != "\0")


def plain(rows):
    """doc_id -> shares, by dictionaries of trigrams; cells only enter through their number."""
    counts = defaultdict(Counter)
    for doc_id, lang, text in rows:
        if doc_id is not None and lang is not None and fold(doc_id) != 2:
            counts[lang] += grams(text)
    languages = sorted(k for k, v in counts.items() if v)
    size = {k: sum(counts[k].values()) + language.SMOOTH * 2 ** language.BITS for k in languages}
    p = lambda k, g: (counts[k][g] + language.SMOOTH) / size[k]

    def fitted(seen, some):
        share = {k: 1 / len(some) for k in some}
        for _ in range(language.ROUNDS):
            new = dict.fromkeys(some, 0.0)
            for g, n in seen.items():
                total = sum(share[k] * p(k, g) for k in some)
                for k in some:
                    new[k] += n * share[k] * p(k, g) / total
            share = {k: v / sum(seen.values()) for k, v in new.items()}
        return share, sum(n * math.log(sum(share[k] * p(k, g) for k in some)) for g, n in seen.items())

    out = {}
    for doc_id, _, text in rows:
        seen = grams(text)
        if not seen or not languages:
            out[doc_id] = {}
            continue
        cost = language.PENALTY * math.log(max(sum(seen.values()), 2))
        full, _ = fitted(seen, languages)
        order = sorted(languages, key=lambda k: (-full[k], k))
        tried = [max(((fitted(seen, [k])[1], {k: 1.0}) for k in languages), key=lambda x: x[0])]
        for k in range(2, len(languages) + 1):
            share, got = fitted(seen, order[:k])
            tried.append((got - cost * (k - 1), share))
        out[doc_id] = max(tried, key=lambda x: x[0])[1]
    return out


def corpus():
    rows = []
    for i in range(60):
        lang = "en de es".split()[i % 3]
        words = TEXTS[lang].split()
        rows.append((i, lang, " ".join(words[(i * 5) % 7:] + words[:i % 9])))
    both = TEXTS["en"] + ". " + TEXTS["de"]
    return rows + [(100, "en", both), (102, None, TEXTS["es"] * 3), (103, "en", both + " " + TEXTS["es"])]


def test_same_mixtures_as_the_plain_version(spark):
    rows = corpus()
    wanted = plain(rows)
    got = {r.doc_id: r for r in language.identify(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for doc_id, share in wanted.items():
        assert set(got[doc_id].shares) == set(share), doc_id
        for k, v in share.items():
            assert got[doc_id].shares[k] == pytest.approx(v, abs=0.02)
        best = max(sorted(share), key=share.get)
        assert got[doc_id].lang_pred == best and got[doc_id].score == pytest.approx(share[best], abs=0.02)
    assert len(got[100].shares) == 2 and len(got[103].shares) == 3


def test_odd_rows(spark):
    odd = [(None, "en", TEXTS["en"]), (None, None, None), (200, "en", None), (201, "de", ""), (202, "es", "12 !? 34"),
           (203, "en", TEXTS["en"]), (203, "en", TEXTS["en"]), (204, "de", (TEXTS["de"] + "\n") * 4000), (205, "en", "你好"),
           (206, "xx", None)]
    got = language.identify(frame(spark, corpus() + odd)).collect()
    assert len(got) == len(corpus()) + len(odd)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert {(r.lang_pred, r.score, r.held_out) for r in by[None]} == {("en", 1.0, False), ("und", 0.0, False)}
    assert all(by[k][0].lang_pred == "und" and by[k][0].score == 0.0 for k in (200, 201, 202))
    assert [r.lang_pred for r in by[203]] == ["en", "en"] and by[204][0].lang_pred == "de"
    assert by[205][0].lang_pred in TEXTS and 0 < by[205][0].score <= 1


def test_nothing_learned(spark):
    assert language.identify(frame(spark, [])).count() == 0
    got = language.identify(frame(spark, [(1, None, "some text"), (2, "en", None)])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_query_finds_the_language_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op13_language(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (fold(r.doc_id) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)
