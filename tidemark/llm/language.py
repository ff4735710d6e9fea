"""Language identification by multilingual mixture inference.

The letters of a text, in lower case, with one boundary between words, give character trigrams.
Each trigram g of a document is taken as drawn from a mixture of languages,

    p(g) = sum over languages l of share(l) * p(g | l),

where p(g | l) comes from the trigram counts of all training texts of l, each count raised by
``SMOOTH``. Expectation-maximisation estimates the shares of every document. The set of languages is
chosen by penalised likelihood: languages are ordered by their share in the full mixture, the first
k are fitted again by themselves, and the k with the largest

    log likelihood - PENALTY * (k - 1) * log(trigrams)

is taken (the smallest on ties). Most documents need no second fit: if even the full mixture gains
less than the penalty of one more language, the best single language stands. The predicted language
is the one with the largest share in the chosen set (the first name on ties), the score is that
share.

Trigrams are told apart by a hash of ``2 ** BITS`` cells, so the model holds that many numbers per
language whatever the corpus holds; its counts cover every training text. The languages are the
distinct values of ``lang`` in the training rows and must be few (a table of languages times cells
goes to every task).

Defined results: a null text or one without a letter is ``und`` with score 0, whatever was learned; a
text whose letters form no known trigram is judged by the smoothed counts like any other. Without
training texts that have letters every text is ``und`` with score 0. Rows are judged one by one, so
repeated ids and null ids are rows like others; rows with a null id teach nothing and are not held
out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, ship, stored

ship(__name__)

BITS = 16
SMOOTH = 0.5
PENALTY = 2.0
ROUNDS = 12
#: Characters of text a task works on at once; a longer text is worked on by itself.
PIECE = 1 << 20
UNDETERMINED = "und"
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(cells of all trigrams of all texts, number of trigrams per text); a text without letters has
    none."""
    sizes = np.zeros(len(texts), np.int64)
    parts = []
    for k, text in enumerate(texts):
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
        c = np.where(_letters()[c], c, np.uint32(0))
        c = np.concatenate([[np.uint32(0)], c, [np.uint32(0)]])
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        if len(c) < 3:
            continue
        cell = c[:-2] * _MIX[0] ^ c[1:-1] * _MIX[1] ^ c[2:] * _MIX[2]
        cell = ((cell ^ (cell >> np.uint32(15))) * _MIX[0])[c[1:-1] != 0] >> np.uint32(32 - BITS)
        sizes[k] = len(cell)
        parts.append(cell.astype(np.int64))
    return (np.concatenate(parts) if parts else np.empty(0, np.int64)), sizes


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows in runs of about ``PIECE`` characters of text."""
    for batch in batches:
        ends = batch["text"].map(lambda t: len(t or "") + 1).cumsum().to_numpy()
        at = 0
        while at < len(batch):
            begun = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begun + PIECE, side="right")))
            yield batch.iloc[at:to]
            at = to


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found: dict[str, np.ndarray] = {}
    for batch in pieces(batches):
        for lang, rows in batch.groupby("lang", sort=False):
            cells, _ = trigrams(rows["text"].tolist())
            counts = np.bincount(cells, minlength=1 << BITS)
            found[lang] = found[lang] + counts if lang in found else counts
    for lang, counts in found.items():
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "cell": at, "n": counts[at]})


@dataclass
class Model:
    languages: list[str]
    #: log2 p(cell | language) as float32, cells in rows.
    logs: np.ndarray


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """Trigram counts of all training texts, summed per language and cell."""
    taught = docs.where((fold_of(F.col("doc_id"), folds) != held_out) & F.col("lang").isNotNull())
    rows = taught.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInPandas(_counts, "lang string, cell long, n long")
    found = stored(counts.groupBy("lang", "cell").agg(F.sum("n").alias("n")), "trigram-counts").toPandas()
    languages = sorted(found["lang"].unique())
    table = np.full((1 << BITS, len(languages)), SMOOTH)
    table[found["cell"], [languages.index(x) for x in found["lang"]]] += found["n"]
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32))


def _grouped(cells: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, cell) in order: text number, cell, count."""
    key = np.repeat(np.arange(len(sizes)), sizes) << BITS | cells
    key, n = np.unique(key, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def shares(p: np.ndarray, n: np.ndarray, text: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares per text and language, log likelihood) of the mixture over the ``allowed`` languages.

    ``p``: per distinct trigram of a text its likelihood under each language, relative to the largest;
    ``text``: its text, 0, 1, ... without gaps; ``n``: how often it occurs.
    """
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    total = _sums(n, starts).astype(np.float32)[:, None]
    share = allowed / allowed.sum(1, keepdims=True, dtype=np.float32)
    for _ in range(ROUNDS):
        part = p * share[text]
        part *= (n / part.sum(1))[:, None]
        share = _sums(part, starts) / total
    with np.errstate(divide="ignore"):
        return share, _sums(n * np.log((p * share[text]).sum(1), dtype=np.float64), starts)


def mixtures(cells: np.ndarray, sizes: np.ndarray, model: Model) -> np.ndarray:
    """Shares of the languages in the set chosen for each text (texts in rows); zeros without
    trigrams."""
    out = np.zeros((len(sizes), len(model.languages)), np.float32)
    rows = np.flatnonzero(sizes)
    if not len(rows) or not model.languages:
        return out
    text, cell, n = _grouped(cells, sizes[rows])
    logs = model.logs[cell]
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    top = logs.max(1, keepdims=True)
    single = _sums((logs - top).astype(np.float64) * n[:, None], starts)
    p, n = np.exp(logs - top), n.astype(np.float32)
    cost = PENALTY * np.log(np.maximum(sizes[rows], 2))
    best, chosen = single.max(1), np.zeros_like(single, np.float32)
    chosen[np.arange(len(rows)), single.argmax(1)] = 1.0
    full, most = shares(p, n, text, np.ones_like(chosen))
    order = np.argsort(-full, axis=1, kind="stable")
    for k in range(2, len(model.languages) + 1):
        open_rows = np.flatnonzero(most - cost * (k - 1) > best)
        if not len(open_rows):
            break
        allowed = np.zeros((len(open_rows), len(model.languages)), np.float32)
        np.put_along_axis(allowed, order[open_rows, :k], 1.0, axis=1)
        of = np.isin(text, open_rows)
        found, gained = shares(p[of], n[of], np.searchsorted(open_rows, text[of]), allowed)
        gained -= cost[open_rows] * (k - 1)
        better = gained > best[open_rows]
        best[open_rows[better]], chosen[open_rows[better]] = gained[better], found[better]
    out[rows] = chosen
    return out


def _judged(model: Model, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in pieces(batches):
            found = mixtures(*trigrams(batch["text"].tolist()), model)
            known = found.sum(1) > 0
            top = found.argmax(1) if len(model.languages) else np.zeros(len(batch), np.int64)
            out = batch[columns].reset_index(drop=True)
            out["lang_pred"] = names[np.where(known, top, len(model.languages))]
            out["score"] = np.minimum(found.max(1, initial=0.0), 1.0).astype(np.float64)
            out["shares"] = [
                {model.languages[i]: float(row[i]) for i in np.flatnonzero(row)} for row in found]
            yield out

    return run


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, and the shares of the languages chosen."""
    model = fit(docs, folds, held_out)
    fold = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    judged = rows.mapInPandas(
        _judged(model, ["doc_id", "held_out"]),
        "doc_id string, held_out boolean, lang_pred string, score double, shares map<string,double>")
    return judged.withColumn("doc_id", F.col("doc_id").cast("long"))
