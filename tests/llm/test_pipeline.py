import hashlib
from collections import Counter

import brute
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def masked(text):
    if text is None:
        return None
    spans = sorted((a, -b, k) for k, a, b in brute.base_spans(text))
    out, at = "", 0
    for a, b, kind in spans:
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = max(at, -b)
    return out + text[at:]


def topic(text):
    if not text:
        return "other"
    marks = ((" | ", "table"), ("!! ", "shout"), ("Licensed under", "licence"))
    return next((name for mark, name in marks if mark in text), "prose")


def drawn(docs):
    """{doc_id} by raking written out over (source, lang, topic) cells."""
    named = [{v for v in mixing.TARGETS[d] if v != "other"} for d in mixing.DIMENSIONS]
    cell = {k: tuple(v if v in n else "other" for v, n in zip((s, lang, topic(t)), named, strict=True)) for k, t, lang, s in docs}
    tokens = Counter()
    for k, t, _, _ in docs:
        tokens[cell[k]] += len((t or "").encode().split())
    tokens = {c: n for c, n in tokens.items() if n}
    total = mixing.SHARE * sum(tokens.values())
    goals = []
    for i, d in enumerate(mixing.DIMENSIONS):
        room = Counter()
        for c, n in tokens.items():
            room[c[i]] += n
        full, goal = set(), {}
        while True:
            rest = sum(mixing.TARGETS[d][v] for v in room if v not in full)
            goal = {v: room[v] if v in full else (total - sum(room[f] for f in full)) * mixing.TARGETS[d][v] / rest for v in room}
            over = {v for v in room if v not in full and goal[v] > room[v]}
            if not over:
                break
            full |= over
        goals.append(goal)
    asked = {c: n * mixing.SHARE for c, n in tokens.items()}
    for _ in range(mixing.ROUNDS):
        for i, goal in enumerate(goals):
            held, free = Counter(), Counter()
            for c, x in asked.items():
                if x >= tokens[c]:
                    held[c[i]] += tokens[c]
                else:
                    free[c[i]] += x
            factor = {v: g / (held[v] + free[v]) if held[v] > g else (g - held[v]) / free[v] if free[v] else 1.0 for v, g in goal.items()}
            asked = {c: x * factor[c[i]] for c, x in asked.items()}
    def prob(c):
        return min(asked[c], tokens[c]) / tokens[c] if c in tokens else 0.0
    return {k for k, c in cell.items() if int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) / 2**32 < prob(c)}


def test_run_equals_the_stages_written_out(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {r.doc_id: r for r in rows if model.score(toxicity.words_of(r.text)) < 0.5}
    near = brute.near_groups({k: r.text for k, r in docs.items()})
    docs = {k: r for k, r in docs.items() if near[k][1] == k}
    leaks = brute.leaks({k: r.text for k, r in docs.items()}, items)
    docs = {k: r for k, r in docs.items() if not leaks[k][1]}
    final = {k: masked(r.text) for k, r in docs.items()}
    taken = drawn([(k, final[k], r.lang, r.source) for k, r in docs.items()])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got.keys() == taken and 0 < len(taken) < len(docs)
    for k, r in got.items():
        assert (r.text, r.n_chars, r.lang, r.source) == (final[k], len(final[k]), docs[k].lang, docs[k].source)


ODD = [
    (1, None, None, None, None, "x", 1), (2, "", "en", "src0", 0, "x", 1), (None, None, "en", None, 3, "x", 1), (None, "same text", "en", "s", 3, "y", 1),
    (3, "a b c d e f g", "en", "src1", 13, "x", 1), (3, "a b c d e f g", "en", "src1", 13, "z", 1), (4, "A B c d e f g", "de", "src1", 13, "x", 1),
    (5, "mail me@x.org now " * 3000, "xx", "zz", 54000, "x", 1),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_every_stage_takes_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, _gone int")
    docs = docs.withColumns({"mix_prob": F.lit(7), "_code": F.lit("c")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert {r.mix_prob for r in out.collect()} <= {7}
        assert set(docs.columns) <= set(out.columns), name
        got = out.collect()
        if name == "near_dedup":
            want = [(1, None), (2, ""), (3, "a b c d e f g"), (5, ODD[-1][1]), (None, None), (None, "same text")] if rows else []
            assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
        elif name == "pii":
            assert sorted(str(r.n_chars) for r in got if r.text is None) == sorted(str(r[4]) for r in rows if r[1] is None)
            assert all(r.n_chars == len(r.text) and "@" not in r.text for r in got if r.text is not None)
        elif name != "mixing":
            assert len(got) == len(rows)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == COLUMNS and out.dtypes == docs.dtypes, name


def test_rows_without_an_id_are_decontaminated(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, item, "a"), (None, item, "b"), (None, "clean text of its own", "c"), (None, None, "d"), (5, item, "e"), (6, "clean", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _code string")
    left = corpus_pipeline.drop_contaminated(spark, docs, SF)
    assert left.columns == docs.columns and sorted(r._code for r in left.collect()) == ["c", "d", "f"]


def test_the_same_row_of_an_id_stays_in_any_order(spark):
    rows = [(1, f"text number {i} of one id", "en", i) for i in range(6)] + [(2, None, "en", 9), (2, "b", "en", 8)]
    schema = "doc_id long, text string, lang string, n int"
    kept = {tuple(sorted(map(str, corpus_pipeline.keep_one_of_each_group(
        spark, spark.createDataFrame(some, schema), SF).collect()))) for some in (rows, rows[::-1])}
    assert len(kept) == 1 and len(kept.pop()) == 2
