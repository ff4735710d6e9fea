"""Spelling variants: words one edit apart, found through Bloom-guided neighbourhoods.

Words are counted over the whole corpus; those of at least ``LEAST_LENGTH`` characters and
``LEAST_COUNT`` occurrences form the vocabulary. Its words are entered in blocked Bloom filters (one
64-bit block per word, ``HASHES`` bits set in it), and every word length has a range of blocks of its
own, sized by its number of words. Each word then generates its edits, and only edits that the filter
of their length holds leave the task:

* every deletion of one character, asked of the next shorter length,
* every replacement of one character by a smaller one of the alphabet in use, asked of its own
  length.

An insertion is a deletion seen from the other word, so each pair is proposed from one side. A join
with the vocabulary removes what the filter let through by chance (about one in a thousand edits).

The filters grow with the vocabulary, so they are sent in rounds of at most ``ROUND_BLOCKS`` blocks
(32 MB): a round holds a range of blocks, and edits that fall elsewhere wait for theirs. Hashes of
edits are sums of one number per character and place, so that a word's edits cost one addition each.

``forms`` links a word to its near word of largest count, if that is at least twice its own; along
such links counts double, so chains are short and are followed by doubling the step.

Defined results: a null or empty text has no words; a null id is written as the empty string where
the id decides which characters are dropped; rows that share an id are counted each. Texts are read
whole, in slices of ``PIECE`` characters cut between words. Words are compared by code points,
whatever their length. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import look_up, ship, stored

ship(__name__)

LEAST_LENGTH, LEAST_COUNT = 5, 3
DROP_ONE_IN = 97
HASHES, BITS_PER_WORD = 6, 24
ROUND_BLOCKS = 1 << 22
#: Distinct words a task counts before it hands them on, edits it looks at at once, characters of a slice.
HELD, EDITS, PIECE = 400_000, 1 << 20, 1 << 22

# The characters of words in Latin-1: A-Z are lowered, all others separate.
_LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))

_draw = np.random.default_rng(20250117)
_CODE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


# ---- words and their counts ------------------------------------------------------------------
def slices(text: str) -> Iterator[bytes]:
    """The text in Latin-1, lowered, with blanks between words, in slices that end between words."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        part = text[at:end].encode("latin-1", "replace").translate(_TO_WORDS)
        while end < len(text) and part[-1] != 0x20:
            more = text[end:end + 4096].encode("latin-1", "replace").translate(_TO_WORDS)
            cut = more.find(b" ")
            part += more if cut < 0 else more[:cut + 1]
            end += len(more) if cut < 0 else cut + 1
        yield part
        at = end


def words_of(doc_id: str, text: str) -> Counter[bytes]:
    """Counts of the words of a text, of the least length at least. The checksum of id and run
    decides which runs lose a character."""
    runs: Counter[bytes] = Counter()
    for part in slices(text):
        runs.update(part.split())
    start, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    for run, n in runs.items():
        if len(run) < LEAST_LENGTH:
            continue
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DROP_ONE_IN == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            if len(run) < LEAST_LENGTH:
                continue
        out[run] += n
    return out


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def out(seen: Counter[bytes]) -> pd.DataFrame:
        words = pd.Series([w.decode("latin-1") for w in seen], dtype=object)
        return pd.DataFrame({"word": words, "n": np.fromiter(seen.values(), np.int64, len(seen))})

    seen: Counter[bytes] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            if text:
                for w, n in words_of(doc_id or "", text).items():
                    seen[w] += n
            if len(seen) > HELD:
                yield out(seen)
                seen.clear()
    yield out(seen)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n, size): the words that are long and frequent enough."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInPandas(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT).withColumn("size", F.char_length("word"))


# ---- Bloom filters ------------------------------------------------------------------------------
def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _STEP)]), dtype=np.uint64)


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every word, words of one size in rows of Latin-1 codes."""
    return (_CODE[codes] * _powers(codes.shape[1])).sum(1, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def blocks_and_bits(h: np.ndarray, start: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and the bits set in it."""
    h = _mixed(h)
    block = start + (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
    low, bits = _mixed(h + _STEP), np.zeros(len(h), np.uint64)
    for k in range(HASHES):
        bits |= np.uint64(1) << ((low >> np.uint64(6 * k)) & np.uint64(63))
    return block, bits


@dataclass
class Shards:
    """First block and number of blocks of every word length in use, and the characters in use."""

    ranges: dict[int, tuple[int, int]]
    words: dict[int, int]
    total: int
    letters: np.ndarray


def shards_of(words: DataFrame) -> Shards:
    sizes = {r["size"]: r["count"] for r in words.groupBy("size").count().collect()}
    chars = words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()
    ranges, at = {}, 0
    for size, n in sorted(sizes.items()):
        blocks = n * BITS_PER_WORD // 64 + 1
        ranges[size] = at, blocks
        at += blocks
    letters = np.array(sorted(ord(r["c"]) for r in chars if r["c"]), np.uint8)
    return Shards(ranges, sizes, at, letters)


def _by_size(words: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places in the batch, codes) of the words of each size."""
    sizes = words.str.len().to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        text = "".join(words.iloc[at]).encode("latin-1")
        yield int(size), at, np.frombuffer(text, np.uint8).reshape(len(at), size)


def _entered(shards: Shards):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, _, codes in _by_size(batch["word"]):
                block, bits = blocks_and_bits(_hashes(codes), *shards.ranges[size])
                yield pd.DataFrame({"block": block, "bits": bits.view(np.int64)})

    return run


def filters(words: DataFrame, shards: Shards) -> DataFrame:
    """(block, bits) of all blocks with words."""
    found = words.select("word").mapInPandas(_entered(shards), "block long, bits long")
    return found.groupBy("block").agg(F.bit_or("bits").alias("bits"))


# ---- near words --------------------------------------------------------------------------------------
def _edits(codes: np.ndarray, shards: Shards) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size of the edit, place, words, new codes, hashes) in bounded parts; new code 0: deletion."""
    size, n = codes.shape[1], len(codes)
    h, powers = _hashes(codes), _powers(size)
    if size - 1 in shards.words:
        # Behind the deleted place every character moves one step back.
        tail = np.zeros(n, np.uint64)
        for i in range(size - 1, -1, -1):
            own = _CODE[codes[:, i]] * powers[i]
            same = np.flatnonzero(codes[:, i] != codes[:, i - 1]) if i else np.arange(n)
            # Of equal neighbours only the first is deleted: the others give the same word.
            yield size - 1, i, same, np.zeros(len(same), np.uint8), (h - own - tail + tail * _BACK)[same]
            tail += own
    if shards.words.get(size, 0) > 1:
        step = max(1, EDITS // max(len(shards.letters), 1))
        for i in range(size):
            for at in range(0, n, step):
                own = codes[at:at + step, i]
                word, letter = np.nonzero(shards.letters[None, :] < own[:, None])
                new = shards.letters[letter]
                word = word + at
                yield size, i, word, new, h[word] + (_CODE[new] - _CODE[codes[word, i]]) * powers[i]


def _proposed(shards: Shards, first: int, held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_bits = held.value
        for batch in batches:
            for _, places, codes in _by_size(batch["word"]):
                names = batch["word"].iloc[places].tolist()
                for at in range(0, len(names), max(1, EDITS // max(codes.shape[1], 1))):
                    some = codes[at:at + max(1, EDITS // max(codes.shape[1], 1))]
                    for edited, i, word, new, h in _edits(some, shards):
                        block, bits = blocks_and_bits(h, *shards.ranges[edited])
                        block -= first
                        here = np.flatnonzero((block >= 0) & (block < len(held_bits)))
                        hit = here[(held_bits[block[here]] & bits[here]) == bits[here]]
                        if not len(hit):
                            continue
                        own = [names[at + w] for w in word[hit]]
                        put = [chr(c) if c else "" for c in new[hit]]
                        edit = [w[:i] + c + w[i + 1:] for w, c in zip(own, put, strict=True)]
                        yield pd.DataFrame({"word": own, "edit": edit}, dtype=object)

    return run


def near_words(words: DataFrame, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """(a, b): all pairs of vocabulary words one edit apart, each once."""
    spark: SparkSession = words.sparkSession
    shards = shards_of(words)
    bits = stored(filters(words, shards), "word-filters")
    parts = max(1, spark.sparkContext.defaultParallelism)
    some = words.select("word").repartition(parts)
    found = None
    for first in range(0, max(shards.total, 1), round_blocks):
        rows = bits.where((F.col("block") >= first) & (F.col("block") < first + round_blocks)).toPandas()
        held = np.zeros(max(1, min(round_blocks, shards.total - first)), np.uint64)
        held[rows["block"].to_numpy(np.int64) - first] = rows["bits"].to_numpy(np.int64).view(np.uint64)
        ask = _proposed(shards, first, spark.sparkContext.broadcast(held))
        part = stored(some.mapInPandas(ask, "word string, edit string"), "proposed-edits")
        found = part if found is None else found.unionByName(part)
    vocabulary = words.select(F.col("word").alias("edit"))
    return found.join(vocabulary, "edit").select(F.col("word").alias("a"), F.col("edit").alias("b"))


# ---- forms and roots ---------------------------------------------------------------------------------
def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n): the near word of largest count, where that is at least twice
    the word's own."""
    n = words.select("word", "n")
    one = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = look_up(one.withColumnRenamed("b", "word"), n, "word").select(
        F.col("a").alias("word"), F.struct((-F.col("n")).alias("back"), F.col("word").alias("form")).alias("near"))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    out = n.join(best, "word", "left")
    form_n = -F.col("near.back")
    taken = form_n >= 2 * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                      F.when(taken, F.col("near.form")).alias("form"), F.when(taken, form_n).alias("form_n"))


def with_roots(linked: DataFrame) -> DataFrame:
    """``root``: from the word along ``form`` to the last; each round doubles the steps taken."""
    steps = stored(linked.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        code = F.xxhash64("root").alias("_code")
        further = steps.select("*", code).join(ahead.select("*", code), ["root", "_code"], "left")
        found = stored(further.select("word", F.coalesce("next", "root").alias("root"),
                                      F.col("next").isNotNull().alias("moved")), "roots")
        steps = found.drop("moved")
        if not found.where("moved").limit(1).count():
            break
    return linked.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, round_blocks: int = ROUND_BLOCKS) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = stored(vocabulary(docs), "vocabulary")
    pairs = stored(near_words(words, round_blocks), "near-words")
    return with_roots(stored(forms(words, pairs), "forms"))
