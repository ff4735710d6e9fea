"""Language-model scoring by deleted interpolation over token n-grams.

Tokens are white-space words in lower case and one end per text. The probability of a token w after a
and b mixes maximum-likelihood estimates of three orders and the uniform one:

    p(w | a, b) = l3 c(a b w) / c(a b) + l2 c(b w) / c(b) + l1 c(w) / N + l0 / (V + 1)

Every n-gram of every training text is counted; texts begin after two start signs. The weights depend
on how often the context was seen: buckets by powers of two of c(a b), or of c(b) where c(a b) is 0. An
order whose context was never seen has weight 0. Weights are learned by expectation-maximisation on
held-out counts: the n-grams of one training fold, estimated from the other folds (the fold is
deleted from the counts). The final counts take that fold in.

Counts come from a question and an answer. Texts are stored in compressed *pieces* of some MB. Each piece
asks for its distinct n-grams, one row per bucket of n-gram hashes, with how often it holds each; a
bucket adds up all pieces' numbers and answers every piece with the counts in the order asked. So an
n-gram travels once per piece, however often the piece has it, a frequent one is one number in each
piece, and buckets hold about ``KEYS`` n-grams each at any size of the corpus. Nothing is kept in every
task, and only the weights and two totals reach the driver.

Buckets are ranges of the hash, so one sort per order puts n-grams in the order of the questions. Words are
told apart by 64 hash bits, longer n-grams by their bucket and ``BITS`` further bits (two of them share a code
by a chance of about KEYS / 2^BITS, 1e-6). A row's hashes travel as low bits and a bitmap of the rising
high parts, two to three bits more than the logarithm of their mean gap. Defined results: a null or empty text is one end token. Rows
that share a doc_id are one document; their texts are scored together. Rows with a null doc_id teach
nothing, are one row of the result and are not held out. Without training text every token is unknown
and the base score uses N = V = 0. An empty table gives an empty result. A text is never cut: one longer
than ``PIECE`` is a piece by itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, ship, stored

ship(__name__)

PIECE, KEYS, BITS = 8 << 20, 4_000_000, 42
#: Bytes of text per distinct n-gram of a piece, about; sets the number of buckets.
BYTES_PER_KEY = 3
#: Tokens that are scored or counted at a time.
SLICE = 1 << 18
LEAST_DEPTH = 2
EM_ROUNDS = 12
LEAST = 1e-6
END, START = np.uint64(0x51AB7E3C9D20F46B), np.uint64(0xA3C59AC2F1B80D17)
_draw = np.random.default_rng(20250301)
_TIMES = _draw.integers(1, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def rows_of(docs: DataFrame, folds: int, held_out: int) -> DataFrame:
    """(doc_id, text bytes, part): part 0 trains, 1 is the training fold EM holds out, 2 teaches
    nothing."""
    doc_id = F.col("doc_id").cast("long")
    fold = fold_of(doc_id, folds)
    part = F.when(fold.isNull() | (fold == held_out), 2).when(fold == (held_out + 1) % folds, 1).otherwise(0)
    return docs.select(doc_id.alias("doc_id"), F.col("text").cast("binary").alias("text"), part.alias("part"))


# ---- pieces -----------------------------------------------------------------------------------------
def _gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    task, at = TaskContext.get().partitionId(), 0
    held: dict[int, tuple[list, list]] = {p: ([], []) for p in (0, 1, 2)}
    sizes = dict.fromkeys(held, 0)

    def out(p: int) -> pd.DataFrame:
        nonlocal at
        at += 1
        ids, texts = held[p]
        held[p], size, sizes[p] = ([], []), sizes[p], 0
        return pd.DataFrame({"piece": [task << 32 | at], "part": p, "size": size, "ids": [ids],
                             "lengths": [[len(t) for t in texts]], "blob": [zstandard.compress(b"".join(texts))]})

    for batch in batches:
        for doc_id, text, p in zip(batch["doc_id"], batch["text"], batch["part"], strict=True):
            text = text or b""
            if held[p][0] and sizes[p] + len(text) > PIECE:
                yield out(p)
            held[p][0].append(None if pd.isna(doc_id) else int(doc_id))
            held[p][1].append(text)
            sizes[p] += len(text) + 1
    for p in held:
        if held[p][0]:
            yield out(p)


def pieces_of(rows: DataFrame) -> DataFrame:
    """Texts of one part in rows of about ``PIECE`` bytes; store them, so that both passes see the same."""
    return rows.mapInPandas(_gathered, "piece long, part int, size long, ids array<long>, lengths array<int>, blob binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def words_of(lengths: np.ndarray, blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token of a piece, one end after each text; tokens of each text)."""
    lengths = np.asarray(lengths, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    data = zstandard.decompress(blob)
    texts = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(starts), pa.py_buffer(data))
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten().dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, flat.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)),
                         np.uint64, len(flat.dictionary))
    full = (pc.binary_length(flat.dictionary).to_numpy() > 0)[flat.indices.to_numpy()]
    upto = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
    sizes = np.diff(upto) + 1
    one, word = np.full(sizes.sum(), END), np.ones(sizes.sum(), bool)
    word[np.cumsum(sizes) - 1] = False
    one[word] = hashes[flat.indices.to_numpy()[full]]
    del texts, split, flat
    pa.default_memory_pool().release_unused()
    return one, sizes


def grams(lengths: np.ndarray, blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of the n-grams of order 1, 2 and 3 that end at each token, tokens of each text)."""
    one, sizes = words_of(lengths, blob)
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate([[START], one[:-1]])
    before[starts] = START
    further = np.concatenate([[START], before[:-1]])
    further[starts] = START
    two = _mixed(before * _TIMES[1] + one * _TIMES[2])
    three = _mixed(_mixed(further * _TIMES[3] + before * _TIMES[4]) + one * _TIMES[5])
    return [_mixed(_mixed(one * _TIMES[0])), two, three], sizes


def packed(keys: np.ndarray) -> bytes:
    """Rising keys: their number, the bits kept as they are, those bits, and a bitmap that holds the rest
    in unary. Any number of keys below 2^64."""
    bits = int(keys[-1]).bit_length()
    low = max(0, bits - (len(keys) - 1).bit_length())
    tail = np.unpackbits(keys.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :low]
    head = keys >> np.uint64(low) if low < 64 else np.zeros_like(keys)
    at = head.astype(np.int64) + np.arange(len(keys))
    marks = np.zeros(int(at[-1]) + 1, np.uint8)
    marks[at] = 1
    return (len(keys).to_bytes(4, "little") + bytes([low]) + np.packbits(tail, bitorder="little").tobytes()
            + np.packbits(marks, bitorder="little").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    n, low = int.from_bytes(data[:4], "little"), data[4]
    split = 5 + (n * low + 7) // 8
    tail = np.zeros((n, 64), np.uint8)
    tail[:, :low] = np.unpackbits(np.frombuffer(data[5:split], np.uint8), count=n * low, bitorder="little").reshape(n, low)
    marks = np.unpackbits(np.frombuffer(data[split:], np.uint8), bitorder="little")
    head = (np.flatnonzero(marks) - np.arange(n)).astype(np.uint64)
    return np.packbits(tail, axis=1, bitorder="little").view("<u8").ravel() | (head << np.uint64(low) if low < 64 else head)


def short(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on, one byte each; 255 stands for those that follow in full."""
    large = numbers >= 255
    return (len(numbers).to_bytes(4, "little") + np.where(large, 255, numbers).astype(np.uint8).tobytes()
            + numbers[large].astype("<i8").tobytes())


def full(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    numbers = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    numbers[numbers == 255] = np.frombuffer(data, "<i8", offset=4 + n)
    return numbers


def placed(found: np.ndarray, order: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of one order in order of bucket and hash: (n-gram, whether it is the first of its kind, place
    of every n-gram of ``found`` among the distinct ones)."""
    if order > 1 and depth + BITS < 64:
        found = found >> np.uint64(64 - depth - BITS)
    by = np.argsort(found)
    rising = found[by]
    first = np.concatenate([[True], rising[1:] != rising[:-1]])
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(first) - 1
    return rising, first, place


def distinct(found: np.ndarray, order: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of one order in order of bucket and hash: (bucket, hash within it, times, place of
    every n-gram in that order). An order has 2^depth buckets."""
    rising, first, place = placed(found, order, depth)
    rest = np.uint64(64 - depth if order == 1 else min(BITS, 64 - depth))
    key = rising[first]
    times = np.diff(np.concatenate([np.flatnonzero(first), [len(first)]]))
    bucket = (key >> rest if depth else np.zeros_like(key)).astype(np.int64) + (order - 1 << depth)
    return bucket, (key & ((np.uint64(1) << rest) - np.uint64(1)) if depth else key), times, place


def _asked(depth: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece, part, lengths, blob in zip(batch["piece"], batch["part"], batch["lengths"], batch["blob"], strict=True):
                for order, found in enumerate(grams(lengths, blob)[0], 1):
                    bucket, key, n, _ = distinct(found, order, depth)
                    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                    yield pd.DataFrame({
                        "bucket": bucket[cuts], "piece": piece, "part": part,
                        "keys": [packed(k) for k in np.split(key, cuts[1:])], "times": [short(t) for t in np.split(n, cuts[1:])]})

    return run


# ---- answers -------------------------------------------------------------------------------------------
ANSWERS = "bucket long, piece long, kept binary, total binary, sums array<long>"


def _answered(asked: pd.DataFrame) -> pd.DataFrame:
    """Counts of every n-gram of one bucket in all training texts, and for the fold that EM holds out in the
    others; a row without a piece has the sums and distinct numbers of both."""
    keys = [unpacked(k) for k in asked["keys"]]
    sizes, part = np.array([len(k) for k in keys]), asked["part"].to_numpy()
    keys = np.concatenate(keys)
    _, place = np.unique(keys, return_inverse=True)
    del keys
    times, of = np.concatenate([full(t) for t in asked["times"]]), np.repeat(part, sizes)
    kept, held = (np.bincount(place, times * (of == p)).astype(np.int64) for p in (0, 1))
    total = kept + held
    cuts = np.cumsum(sizes)[:-1]
    mine = [short(kept[at]) if p == 1 else None for at, p in zip(np.split(place, cuts), part, strict=True)]
    whole = [short(total[at]) for at in np.split(place, cuts)]
    sums = [int(x) for c in (kept, total) for x in (c.sum(), np.count_nonzero(c))]
    return pd.DataFrame({
        "bucket": asked["bucket"].iloc[0], "piece": [*asked["piece"], None], "kept": [*mine, None], "total": [*whole, None],
        "sums": [*[None] * len(sizes), sums]}).astype({"piece": "Int64"})


def answers_of(pieces: DataFrame, depth: int) -> DataFrame:
    asked = pieces.select("piece", "part", "lengths", "blob").mapInPandas(
        _asked(depth), "bucket long, piece long, part int, keys binary, times binary")
    return asked.groupBy("bucket").applyInPandas(_answered, ANSWERS)


def _counted(piece: pd.DataFrame, answers: pd.DataFrame, depth: int, column: str) -> tuple[np.ndarray, ...]:
    """Per token: c(abw), c(ab), c(bw), c(b), c(w); and the tokens of each text. ``column`` says whether
    the fold that EM holds out counts."""
    found, sizes = grams(piece["lengths"].iloc[0], piece["blob"].iloc[0])
    answers = answers.sort_values("bucket")
    order = answers["bucket"].to_numpy() >> depth
    one, two, three = (
        np.concatenate([full(t) for t in answers[column][order == k]])[placed(found.pop(0), k + 1, depth)[2]] for k in range(3))
    starts = np.cumsum(sizes) - sizes
    texts = one[-1]  # every text has one end
    ctx_one, ctx_two = np.concatenate([[texts], one[:-1]]), np.concatenate([[texts], two[:-1]])
    ctx_one[starts] = ctx_two[starts] = texts
    return three, ctx_two, two, ctx_one, one, sizes


def bucket_of(pair: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Bucket of a context by how often it was seen; -1: never."""
    with np.errstate(divide="ignore"):
        near = np.where(single > 0, np.log2(np.maximum(single, 1)), -1)
        far = np.where(pair > 0, 64 + np.log2(np.maximum(pair, 1)), -1)
    return np.where(pair > 0, far, near).astype(np.int64)


def _slices(counts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Counts of ``SLICE`` tokens at a time, so that what is derived from them stays small."""
    for at in range(0, len(counts[0]), SLICE):
        yield [c[at:at + SLICE] for c in counts]


# ---- weights ----------------------------------------------------------------------------------------------
HELD = "bucket long, c3 long, x3 long, c2 long, x2 long, c1 long, n long"


def _held_counts(depth: int):
    def run(piece: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        *counts, _ = _counted(piece, answers, depth, "kept")
        parts = []
        for c3, x3, c2, x2, c1 in _slices(counts):
            rows = pd.DataFrame({"bucket": bucket_of(x3, x2), "c3": c3, "x3": x3, "c2": c2, "x2": x2, "c1": c1})
            parts.append(rows.groupby(list(rows), sort=False).size().reset_index(name="n"))
        return pd.concat(parts)

    return run


def allowed(bucket: int, tokens: int) -> np.ndarray:
    """Which orders 3, 2, 1, 0 have a context in a bucket."""
    return np.array([bucket >= 64, bucket >= 0, tokens > 0, True], float)


def settled(weights: np.ndarray, usable: np.ndarray) -> np.ndarray:
    weights = np.maximum(weights, LEAST) * usable
    return weights / weights.sum()


def weights_of(held: DataFrame, tokens: int, words: int, rounds: int = EM_ROUNDS) -> dict[int, np.ndarray]:
    """Weights of orders 3, 2, 1, 0 per bucket by expectation-maximisation over stored held-out counts;
    a bucket's sums are all that leaves a round."""
    n = F.col("n").cast("double")
    part = [F.coalesce(F.try_divide(F.col(c), F.col(x)), F.lit(0.0)) for c, x in (("c3", "x3"), ("c2", "x2"))]
    part += [F.col("c1") / float(max(tokens, 1)), F.lit(1.0 / (words + 1))]
    found = stored(held.select("bucket", n.alias("n"), *[e.cast("double").alias(f"e{k}") for k, e in enumerate(part)]), "held-estimates")
    weights = {r["bucket"]: settled(np.full(4, 0.25), allowed(r["bucket"], tokens)) for r in found.select("bucket").distinct().collect()}
    for _ in range(rounds):
        now = {k: F.create_map(*[F.lit(x) for b, w in weights.items() for x in (b, float(w[k]))])[F.col("bucket")] for k in range(4)} if weights else {}
        if not now:
            break
        mixed = [now[k] * F.col(f"e{k}") for k in range(4)]
        total = mixed[0] + mixed[1] + mixed[2] + mixed[3]
        sums = found.groupBy("bucket").agg(*[F.sum(F.col("n") * m / total).alias(f"s{k}") for k, m in enumerate(mixed)])
        for r in sums.collect():
            s = np.array([r[f"s{k}"] for k in range(4)])
            weights[r["bucket"]] = settled(s / s.sum(), allowed(r["bucket"], tokens))
    return weights


# ---- scores ------------------------------------------------------------------------------------------------
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scored(depth: int, weights: dict[int, np.ndarray], tokens: int, words: int):
    def run(piece: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        *counts, sizes = _counted(piece, answers, depth, "total")
        scores = []
        for c3, x3, c2, x2, c1 in _slices(counts):
            estimate = np.stack([
                c3 / np.maximum(x3, 1), c2 / np.maximum(x2, 1), c1 / max(tokens, 1), np.full(len(c1), 1 / (words + 1))])
            seen, place = np.unique(bucket_of(x3, x2), return_inverse=True)
            table = np.stack([weights.get(int(b), settled(np.full(4, 0.25), allowed(b, tokens))) for b in seen])
            scores.append(np.log10((table[place].T * estimate).sum(0)))
        score, c1 = np.concatenate(scores), counts[4]
        del counts, scores
        base = np.log10((c1 + 1) / (tokens + words + 1))
        text, n = np.repeat(np.arange(len(sizes)), sizes), len(sizes)
        ids = pd.array([None if pd.isna(x) else int(x) for x in piece["ids"].iloc[0]], dtype="Int64")
        return pd.DataFrame({
            "doc_id": ids, "n_tokens": sizes, "n_known": np.bincount(text, c1 > 0, n).astype(np.int64),
            "base_score": np.bincount(text, base, n), "score": np.bincount(text, score, n)})

    return run


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, keys: int = KEYS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    pieces = stored(pieces_of(rows_of(docs, folds, held_out)), "ngram-pieces")
    size = pieces.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    depth = max(LEAST_DEPTH, (size // (BYTES_PER_KEY * keys)).bit_length())
    answers = stored(answers_of(pieces, depth), "ngram-answers")
    totals = answers.where(F.col("piece").isNull() & (F.col("bucket") < 1 << depth)).agg(*[
        F.coalesce(F.sum(F.col("sums")[k]), F.lit(0)) for k in range(4)]).head()
    asked = answers.where(F.col("piece").isNotNull())

    def met(some: DataFrame, column: str, run, schema: str) -> DataFrame:
        return some.select("piece", "ids", "lengths", "blob").groupBy("piece").cogroup(
            asked.select("piece", "bucket", column).groupBy("piece")).applyInPandas(
            lambda a, b: run(a, b) if len(a) else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")]), schema)

    held = met(pieces.where("part = 1"), "kept", _held_counts(depth), HELD)
    held = held.groupBy("bucket", "c3", "x3", "c2", "x2", "c1").agg(F.sum("n").alias("n"))
    weights = weights_of(held, totals[0], totals[1])
    found = met(pieces, "total", _scored(depth, weights, totals[2], totals[3]), SCORED)
    each = found.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    fold: Column = F.coalesce(fold_of(F.col("doc_id"), folds) == held_out, F.lit(False))
    return each.select("doc_id", fold.alias("held_out"), "n_tokens", "n_known",
                       F.lit(totals[2]).cast("long").alias("train_tokens"), "base_score", "score")
