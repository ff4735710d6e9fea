"""Mixing sources to target weights: raking by iterative proportional fitting, then sampling.

Documents are counted by (source, language, topic) cell; values that the targets do not name are
pooled as 'other', so the targets bound the number of cells. Cells start at the wanted share of their
tokens and are scaled to the source, language and topic targets in turn until all three hold. A cell
cannot give more tokens than it has: where it would, it counts with all it has, and the other cells of
the value are scaled to what is left of the target. A document of a cell is taken with the cell's
calibrated probability, its wanted tokens over its tokens, so the expected sample meets the targets and
holds the wanted number of tokens.

A target above what a value holds is infeasible: the value gives all it has, and the rest of the
dimension shares what is missing in proportion. ``marginals`` reports wanted, feasible and expected
tokens of every value; cells may also contradict each other through their sizes, which shows there.

The draw is a hash of the document id, so a run can be repeated and equal ids share their fate.

Defined results: null and unnamed sources, languages and topics are 'other'. Targets of values
that no document has are dropped and the rest scaled to one. Null and empty texts hold no tokens;
their cell decides for them like for others, with probability 0 if the cell holds no tokens. A null
doc_id is drawn as the empty string. Texts are read whole; other columns are handed on as they are.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 100
#: Tokens wanted, as a share of all tokens.
SHARE = 0.5
TARGETS: dict[str, dict[str, float]] = {
    "source": {**{f"src{i}": 0.045 for i in range(20)}, OTHER: 0.1},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, OTHER: 0.05},
    "topic": {"prose": 0.8, "table": 0.05, "shout": 0.05, "licence": 0.05, OTHER: 0.05},
}


def topic_of(text: Column) -> Column:
    """A topic by layout; null and empty texts have none."""
    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, OTHER)
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("!! ")), "shout")
        .when(F.contains(text, F.lit("Licensed under")), "licence")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    words = F.split(F.coalesce(text, F.lit("")), "[\x20\x09-\x0d]+")
    return F.size(F.array_remove(words, "")).cast("long")


def celled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) with unnamed values pooled."""
    return docs.select("doc_id", *cell_columns(targets), token_count(F.col("text")).alias("tokens"))


def cell_columns(targets: Mapping[str, Mapping[str, float]]) -> list[Column]:
    values = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}
    return [
        F.when(values[d].isin([v for v in targets[d] if v != OTHER]), values[d]).otherwise(OTHER).alias(d)
        for d in DIMENSIONS
    ]


def feasible(room: np.ndarray, wanted: np.ndarray, total: float) -> np.ndarray:
    """Tokens of the values of a dimension: in proportion to ``wanted``, none above its ``room``, in sum
    ``total``."""
    full = np.zeros(len(room), bool)
    while True:
        rest = wanted * ~full
        out = np.where(full, room, (total - room[full].sum()) * rest / max(rest.sum(), 1e-300))
        over = ~full & (out > room)
        if not over.any():
            return out
        full |= over


def raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS,
          rounds: int = ROUNDS, share: float = SHARE) -> list[tuple]:
    """(source, lang, topic, tokens, weight, prob) per cell; the cells are as many as the targets
    allow, whatever the corpus holds."""
    rows = [tuple(r) for r in cells.groupBy(*DIMENSIONS).agg(F.sum("tokens")).collect()]
    rows = sorted(r for r in rows if r[3])
    if not rows:
        return []
    tokens = np.array([r[3] for r in rows], float)
    total = tokens.sum() * share
    at, goals = [], []
    for k, d in enumerate(DIMENSIONS):
        values = sorted({r[k] for r in rows})
        place = np.array([values.index(r[k]) for r in rows])
        room = np.bincount(place, tokens)
        wanted = np.array([targets[d].get(v, 0.0) for v in values])
        at.append(place)
        goals.append(feasible(room, wanted if wanted.sum() else room, total))
    asked = tokens * share
    for _ in range(rounds):
        for place, goal in zip(at, goals, strict=True):
            full = asked >= tokens
            held, free = np.bincount(place, tokens * full, len(goal)), np.bincount(place, asked * ~full, len(goal))
            # More than the target in full cells alone: all shrink. Otherwise the free ones take the rest.
            factor = np.where(held > goal, goal / np.maximum(held + free, 1e-300),
                              np.where(free > 0, (goal - held) / np.maximum(free, 1e-300), 1.0))
            asked = asked * factor[place]
    given = np.minimum(asked, tokens)
    return [(*r, float(g / given.sum()), float(g / r[3])) for r, g in zip(rows, given, strict=True)]


def marginals(plan: list[tuple], targets: Mapping[str, Mapping[str, float]] = TARGETS,
              share: float = SHARE) -> list[tuple]:
    """(dimension, value, wanted, feasible, expected tokens) of every value of a ``raked`` plan."""
    out, total = [], share * sum(r[3] for r in plan)
    for k, d in enumerate(DIMENSIONS):
        values = sorted({r[k] for r in plan})
        room = np.array([sum(r[3] for r in plan if r[k] == v) for v in values], float)
        wanted = np.array([targets[d].get(v, 0.0) for v in values])
        wanted = wanted if wanted.sum() else room
        goal = feasible(room, wanted, total)
        expected = [sum(r[3] * r[5] for r in plan if r[k] == v) for v in values]
        out += [(d, v, float(total * w / wanted.sum()), float(g), float(e))
                for v, w, g, e in zip(values, wanted, goal, expected, strict=True)]
    return out


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the document id."""
    first = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 8), 16, 10)
    return first.cast("double") / float(1 << 32)


def plan_of(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], rounds: int,
            share: float) -> DataFrame:
    found = raked(celled(docs, targets), targets, rounds, share)
    return docs.sparkSession.createDataFrame(
        [(*r[:3], float(r[4]), float(r[5])) for r in found],
        "source string, lang string, topic string, cell_weight double, prob double")


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS,
          rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """Per row: doc_id, source, lang, topic, tokens, cell_weight (the cell's share of the mix),
    prob, sampled."""
    plan = plan_of(docs, targets, rounds, share)
    out = celled(docs, targets).join(F.broadcast(plan), list(DIMENSIONS), "left")
    prob = F.coalesce("prob", F.lit(0.0))
    return out.select("doc_id", *DIMENSIONS, "tokens",
                      F.coalesce("cell_weight", F.lit(0.0)).alias("cell_weight"),
                      prob.alias("prob"), (draw(F.col("doc_id")) < prob).alias("sampled"))


def sampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] = TARGETS,
            rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """The drawn rows with all their columns, and ``mix_prob`` (or, where a column has that name already,
    the first free one of ``mix_prob_2``, ...)."""
    name, n = "mix_prob", 1
    while name in docs.columns:
        n += 1
        name = f"mix_prob_{n}"
    plan = plan_of(docs, targets, rounds, share)
    probs = F.map_from_arrays(F.collect_list(F.concat_ws("/", *DIMENSIONS)), F.collect_list("prob"))
    by_cell = plan.agg(probs).head()[0]
    cell = F.concat_ws("/", *cell_columns(targets))
    if not by_cell:
        return docs.where(F.lit(False)).withColumn(name, F.lit(0.0))
    known = F.create_map(*[F.lit(x) for pair in by_cell.items() for x in pair])
    prob = F.coalesce(F.try_element_at(known, cell), F.lit(0.0))
    return docs.withColumn(name, prob).where(draw(F.col("doc_id")) < F.col(name))
