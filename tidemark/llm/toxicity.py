"""Toxicity: a logistic classifier that is penalised when swapping identity terms changes a score.

Training rows are a bounded sample of the labelled documents (``SAMPLE`` rows with the smallest id
hash), so the fit costs the same at any corpus size. Words are features if their counts in toxic
and other sample documents differ more than chance over so many words allows; identity terms
are always features. For every labelled sentence with an identity term, counterfactuals put each
other term of the same group in its place, and the fit minimises

    log loss + RIDGE |w|^2 / 2 + SWAP * mean squared score change over counterfactuals.

Scores use the words of the whole text only, however long it is. Rows are scored one by one, so repeated
and null ids are rows like others (the query counts a null id as not held out), an empty table gives an
empty result, and other columns are not read. Defined results: a null or empty text scores like a
text without features. Labels other than 0 and 1, or null, and labelled ids without a document
teach nothing. Without any usable label every score is 0.5 less a hair, so nothing is rejected; a
class that never occurs in the sample is smoothed by half a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, ship, stored

ship(__name__)

SAMPLE = 20_000
RIDGE, SWAP = 0.1, 10.0
STEPS = 60
BEGINNINGS = (3, 4, 5, 6)
#: Smallest number of sample documents a feature word is in.
LEAST_DOCS = 3

# Groups of terms that may stand for one another.
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("immigrant", "refugee", "foreigner", "local"),
    ("old", "young", "elderly"),
    ("disabled", "deaf", "blind"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme", "fille", "garçon"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "hétérosexuels", "lesbiennes", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "migrants"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslim", "christ", "jude", "buddhist", "atheist"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("homosexuelle", "heterosexuelle", "lesben", "bisexuelle", "schwule"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("mujer", "hombre", "chica", "chico"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "locales"),
)
SWAPS = {t: tuple(sorted({o for g in IDENTITY if t in g for o in g} - {t})) for group in IDENTITY for t in group}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(words: set[str]) -> set[str]:
    """The words, and their beginnings of three to six letters marked with an asterisk: languages
    that build words from stems say the same in many forms. Identity terms count as whole words
    only, so that a swap changes nothing but the terms."""
    return words.union(w[:k] + "*" for w in words - SWAPS.keys() for k in BEGINNINGS if len(w) > k)


def counterfactuals(text: str | None) -> set[tuple[str, str]]:
    """(term, other) of every swap that a sentence of the text allows."""
    out = set()
    for sentence in _SENTENCE.split((text or "").lower()):
        for term in SWAPS.keys() & set(_WORD.findall(sentence)):
            out.update((term, other) for other in SWAPS[term])
    return out


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, words: set[str]) -> float:
        known = features_of(words) & self.weights.keys()
        z = self.bias + sum(self.weights[w] for w in sorted(known))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))


def sample(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5,
           size: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``size`` labelled documents outside the held-out fold.

    The ids and labels are bounded by ``size``, 16 bytes each, and are sent to every task.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held_out_fold))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id")


def _sample_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({
            "toxic": batch["toxic"], "words": [sorted(features_of(words_of(t))) for t in batch["text"]],
            "swaps": [[f"{a} {b}" for a, b in sorted(counterfactuals(t))] for t in batch["text"]]})


def feature_words(rows: DataFrame, n: tuple[int, int]) -> list[str]:
    """All words and beginnings whose share of toxic rows is beyond chance: likelihood ratio over
    2 ln(words). Of those that begin alike the strongest stays, of equally strong ones the longest.

    ``n``: rows of class 0 and 1. The bounded sample bounds the words.
    """
    toxic = F.col("toxic")
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(toxic).alias("pos"), F.sum(1 - toxic).alias("neg"))
    counts = stored(counts, "word-counts")
    vocabulary = max(counts.count(), 2)
    other, pos_all = n
    share = (F.col("pos") + F.col("neg")) / F.lit(float(other + pos_all))

    def part(seen: str, total: int) -> Column:
        mean = share * total
        rest, rest_mean = F.lit(total) - F.col(seen), F.lit(total) - mean
        one = F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / mean)).otherwise(0.0)
        two = F.when((rest > 0) & (rest_mean > 0), rest * F.log(rest / rest_mean)).otherwise(0.0)
        return one + two

    ratio = 2 * (part("pos", pos_all) + part("neg", other))
    beyond = (F.col("pos") + F.col("neg") >= LEAST_DOCS) & (ratio > 2 * float(np.log(vocabulary)))
    best = counts.where(beyond).select("word", ratio.alias("g"))
    found = sorted(((r["g"], len(r["word"]), r["word"]) for r in best.collect() if r["word"] not in SWAPS), reverse=True)
    kept: list[str] = []
    stems: set[str] = set()
    within: set[str] = set()
    for _, _, word in found:
        stem = word.rstrip("*")
        ahead = {stem[:k] for k in range(1, len(stem) + 1)}
        if stem not in within and not ahead & stems:
            kept.append(word)
            stems.add(stem)
            within |= ahead
    return sorted(kept)


def _known(at: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(words=[sorted(at[w] for w in words if w in at) for words in batch["words"]])

    return run


def _solved(times, b: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """x with times(x) = b by conjugate gradients, scaled by the diagonal."""
    x, rest = np.zeros_like(b), b.copy()
    z = rest / diagonal
    ahead, size = z.copy(), float(rest @ z)
    for _ in range(4 * len(b)):
        if np.sqrt(rest @ rest) <= 1e-10 * np.sqrt(b @ b) or size == 0.0:
            break
        image = times(ahead)
        far = size / float(ahead @ image)
        x += far * ahead
        rest -= far * image
        z = rest / diagonal
        size, before = float(rest @ z), size
        ahead = z + size / before * ahead
    return x


def fit(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, folds: int = 5,
        size: int = SAMPLE, swap: float = SWAP, ridge: float = RIDGE) -> Model:
    """Newton steps on the driver over the bounded sample's feature words, kept as the places of the
    words in each distinct row."""
    chosen = sample(docs, labels, held_out_fold, folds, size)
    rows = stored(chosen.mapInPandas(
        _sample_words, "toxic int, words array<string>, swaps array<string>"), "toxic-sample")
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    other, pos = n.get(0, 0), n.get(1, 0)
    if not other + pos:
        return Model(-1e-6, {})
    names = feature_words(rows, (other, pos))
    names = sorted({*names, *SWAPS})
    at = {w: i for i, w in enumerate(names)}
    known = rows.mapInPandas(_known(at), "toxic int, words array<int>, swaps array<string>")
    few = known.groupBy("words", "swaps").agg(
        F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    width = len(names) + 1
    col = np.array([i for r in few for i in [*r["words"], width - 1]], np.int64)
    row = np.repeat(np.arange(len(few)), [len(r["words"]) + 1 for r in few])
    pos_at, n_at = (np.array([r[c] for r in few], float) for c in ("pos", "n"))
    change: dict[tuple[int, int], float] = {}
    swaps = 0
    for r in few:
        for pair in r["swaps"]:
            a, b = (at[w] for w in pair.split(" "))
            for i, j, sign in ((a, a, 1), (b, b, 1), (a, b, -1), (b, a, -1)):
                change[i, j] = change.get((i, j), 0.0) + sign * r["n"]
            swaps += r["n"]
    one, two = (np.array([key[k] for key in change], np.int64) for k in (0, 1))
    value = swap * n_at.sum() * np.array(list(change.values()), float) / max(swaps, 1)
    shrink = np.full(width, ridge)
    shrink[-1] = 0.0

    def sums(u: np.ndarray) -> np.ndarray:
        return np.bincount(col, u[row], width)

    def of_rows(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, v[col], len(few))

    def penalty(v: np.ndarray) -> np.ndarray:
        return shrink * v + np.bincount(one, value * v[two], width)

    w = np.zeros(width)
    w[-1] = np.log((pos + 0.5) / (other + 0.5))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(of_rows(w), -500, 500)))
        # Half a row of each class without words keeps the bias finite.
        plain = 1 / (1 + np.exp(-w[-1]))
        gradient = sums(n_at * p - pos_at) + penalty(w)
        gradient[-1] += plain - 0.5
        bend, last = n_at * p * (1 - p), np.zeros(width)
        last[-1] = plain * (1 - plain) + 1e-6
        diagonal = sums(bend) + shrink + np.bincount(one[one == two], value[one == two], width) + last
        step = _solved(lambda v: sums(bend * of_rows(v)) + penalty(v) + last * v, gradient, diagonal)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Model(float(w[-1]), dict(zip(names, w[:-1].tolist(), strict=True)))


def score(text: Column, model: Model) -> Column:
    """Probability that the text is toxic, from its words alone."""

    @F.pandas_udf("double")
    def toxic_score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(words_of(t)) for t in texts], dtype="float64")

    return toxic_score(text)
