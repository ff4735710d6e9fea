"""Manual corrections against official results, merge rules and the prediction lock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import exprs as X
from tidemark.operators import scale


def merge_latest(
    existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str], sequence: str = "_seq"
) -> DataFrame:
    """Union by key, incoming over existing, the later row inside each.

    The first load is deduplicated as well, so a key is unique from the start.
    """
    late = incoming.withColumn("_turn", F.lit(1))
    both = late if existing is None else existing.withColumn("_turn", F.lit(0)).unionByName(
        late, allowMissingColumns=True
    )
    order = ["_turn", *([sequence] if sequence in both.columns else [])]
    return scale.keep_last(both, keys, *order).drop("_turn")


def with_notes(results: DataFrame) -> DataFrame:
    """Older files have no notes column."""
    if "notes" in results.columns:
        return results
    return results.withColumn("notes", F.lit(""))


def first_usable(rows: DataFrame, sequence: str, last: bool) -> DataFrame:
    """Adds ``_chosen``: true for the one usable row of each game that counts.

    Usable rows (without a reject reason) are ranked by sequence, then by all their values, so
    equal or missing sequence numbers still give one choice. The rank is taken within 64 hash parts
    of a game first and the parts' best are compared after, so no game has to fit into one task.
    """
    values = [c for c in rows.columns if c != "reject_reason"]
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in values]
    rows = rows.withColumns({
        "_usable": F.col("reject_reason").isNull(), "_mark": F.sha2(F.concat_ws("\x1f", *shown), 256),
    })
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_mark"), F.lit(64)))
    order = F.desc_nulls_last(sequence) if last else F.asc_nulls_last(sequence)
    w = Window.partitionBy("game_id", "_usable", "_part").orderBy(order, "_mark")
    rows = rows.withColumn("_rank", F.row_number().over(w))
    best = scale.top_per_key(
        rows.filter("_usable AND _rank = 1").select("game_id", sequence, "_mark", "_part"),
        ["game_id"], [order, F.col("_mark")], 1,
    ).select(F.col("game_id").alias("_game"), F.col("_part").alias("_best"))
    rows = rows.join(best, F.col("game_id").eqNullSafe(F.col("_game")), "left")
    chosen = F.col("_usable") & (F.col("_rank") == 1) & (F.col("_part") == F.col("_best"))
    return rows.withColumn("_chosen", F.coalesce(chosen, F.lit(False))).drop(
        "_usable", "_mark", "_part", "_rank", "_game", "_best"
    )


def check_corrections(
    corrections: DataFrame, games: DataFrame, existing: DataFrame,
    allow_overwrite: bool = False, sequence: str = "_seq",
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a correction batch; every row is in one of the two.

    Accepted rows have the result columns with the winner worked out from the scores; rejected
    rows carry a reason. A game already corrected is refused unless overwriting is allowed, and
    so is a second row for the same game inside the batch (the first one by sequence counts, or the
    last one if overwriting is allowed; a hash of the row decides between equal numbers). A schedule
    that repeats an id counts once, with the smallest names.
    """
    teams = scale.top_per_key(
        games.select("game_id", "home_team", "away_team"), ["game_id"],
        [F.col("home_team").asc_nulls_last(), F.col("away_team").asc_nulls_last()], 1)
    known = existing.select("game_id").distinct().withColumn("_known", F.lit(True))
    rows = corrections.join(teams, "game_id", "left").join(known, "game_id", "left")
    home, away = F.col("home_score"), F.col("away_score")
    whole = X.number(home).isNotNull() & X.number(away).isNotNull() \
        & (X.number(home) == F.floor(X.number(home))) & (X.number(away) == F.floor(X.number(away)))
    reason = (
        F.when(F.col("home_team").isNull(), "unknown_game")
        .when(~whole, "scores_not_integers")
        .when((home < 0) | (away < 0), "negative_score")
        .when(home == away, "tie_not_allowed")
        .when(~X.valid_source("source"), "invalid_source")
    )
    if not allow_overwrite:
        reason = F.coalesce(reason, F.when(F.col("_known"), "already_exists"))
    rows = first_usable(rows.withColumn("reject_reason", reason), sequence, allow_overwrite)
    reason = F.coalesce("reject_reason", F.lit("duplicate_in_batch"))
    rejected = rows.filter("NOT _chosen").withColumn("reject_reason", reason)
    winner = F.when(home > away, F.col("home_team")).otherwise(F.col("away_team"))
    accepted = rows.filter("_chosen").select(
        "game_id", home.cast("int").alias("home_score"), away.cast("int").alias("away_score"),
        winner.alias("winner"), F.lower(X.strip("source")).alias("source"), "confirmed_at",
        F.coalesce(X.strip("notes"), F.lit("")).alias("notes"),
    )
    return accepted, rejected.select(*corrections.columns, "reject_reason")


def apply_corrections(existing: DataFrame, accepted: DataFrame) -> DataFrame:
    """The corrected table in its fixed column order."""
    merged = merge_latest(with_notes(existing), accepted, ["game_id"], sequence="confirmed_at")
    return merged.select(*schemas.MANUAL_COLUMNS)


def compare_results(manual: DataFrame, official: DataFrame, sequence: str = "_seq") -> DataFrame:
    """Per game: match, mismatch, or which side is missing. Duplicate games use their first row."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        order = sequence if sequence in df.columns else "game_id"
        one = scale.keep_first(df, ["game_id"], order)
        return one.select(
            F.col("game_id").cast("string").alias("game_id"), F.lit(True).alias(f"{prefix}_there"),
            X.number("home_score").cast("long").alias(f"{prefix}_home"),
            X.number("away_score").cast("long").alias(f"{prefix}_away"),
            F.coalesce(X.strip("winner"), F.lit("")).alias(f"{prefix}_winner"),
        )

    both = side(manual, "m").join(side(official, "o"), "game_id", "full")
    differ = (F.col("m_home") != F.col("o_home")) | (F.col("m_away") != F.col("o_away"))
    named = (F.col("m_winner") != "") & (F.col("o_winner") != "")
    status = (
        F.when(F.col("m_there").isNull(), "no_manual_result_available")
        .when(F.col("o_there").isNull(), "no_official_result_available")
        .when(differ | (named & (F.col("m_winner") != F.col("o_winner"))), "mismatch")
        .otherwise("match")
    )
    return both.select("game_id", status.alias("comparison_status"))


def manual_summary(manual: DataFrame, official: DataFrame | None) -> DataFrame:
    """Counts of corrections overall, per source, and against the official results."""
    def metric(df: DataFrame, name) -> DataFrame:
        return df.select(X.as_col(name).alias("metric"), F.col("n").alias("value"))

    n = F.count(F.lit(1)).alias("n")
    out = metric(manual.agg(n), F.lit("manual_override_count"))
    by_source = manual.groupBy("source").agg(n).filter("source IS NOT NULL")
    out = out.unionByName(metric(by_source, F.concat(F.lit("source_"), F.col("source"))))
    if official is None:
        return out
    status = compare_results(manual, official).agg(
        F.count_if(F.col("comparison_status") == "mismatch").alias("mismatch_vs_game_results"),
        F.count_if(F.col("comparison_status") == "match").alias("match_vs_game_results"),
    )
    return out.unionByName(status.unpivot([], status.columns, "metric", "value"))


# ---- overlays ------------------------------------------------------------------------------
def overlay(layers: Sequence[tuple[str, DataFrame]], keys: Sequence[str], value: str) -> DataFrame:
    """Last non-blank value per key over the layers, lowest priority first, with its source."""
    parts = [
        df.filter(~X.is_blank(value) & ~X.any_null(*keys)).select(
            *keys, X.strip(value).alias(value), F.lit(source).alias("source"), F.lit(i).alias("_p")
        )
        for i, (source, df) in enumerate(layers)
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    best = F.max_by(F.struct(value, "source"), F.struct("_p", value))
    return both.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{value}", "_b.source")


#: What a filled-in column of each role says about a game being over.
_OVER = {
    "winner": lambda c: ~X.is_blank(c),
    "score": lambda c: F.col(c).isNotNull(),
    "status": lambda c: F.coalesce(F.lower(F.col(c)).rlike("|".join(schemas.OVER_STATUS)), F.lit(False)),
}


def completed(df: DataFrame) -> Column:
    """Rows whose game is over, judged by the result and status columns the table has."""
    role_of = {name: role for role, names in schemas.OVER_COLUMNS.items() for name in names}
    signs = [_OVER[role_of[c.lower()]](c) for c in df.columns if c.lower() in role_of]
    return F.array_contains(F.array(*signs), True) if signs else F.lit(False)


def lock_predictions(
    current: DataFrame, snapshot: DataFrame, sequence: str = "_seq",
    columns: Sequence[str] = schemas.LOCKED_COLUMNS,
) -> DataFrame:
    """Completed games keep the prediction columns they had in the snapshot, unless blank there.

    ``columns`` names the locked columns; those that either table lacks are passed over.
    """
    locked = [c for c in columns if c in current.columns and c in snapshot.columns]
    if not locked:
        return current
    # Ids are padded first: two spellings of an id are one game.
    order = [sequence] if sequence in snapshot.columns else []
    padded = snapshot.withColumn("_id", X.pad_id("game_id"))
    old = scale.keep_last(padded, ["_id"], *order, "game_id", *locked).select(
        "_id", *[F.col(c).alias(f"_old_{c}") for c in locked]
    )
    done = completed(current)
    types = dict(current.dtypes)
    rows = current.withColumn("_id", X.pad_id("game_id")).join(old, "_id", "left")
    return rows.withColumns({
        c: F.when(
            done & (F.coalesce(X.strip(f"_old_{c}"), F.lit("")) != ""),
            F.col(f"_old_{c}").cast(types[c]),
        ).otherwise(F.col(c))
        for c in locked
    }).select(*current.columns)


def enrich_first(df: DataFrame, lookup: DataFrame, columns: Sequence[str],
                 sequence: str = "_seq") -> DataFrame:
    """Attach the first matching lookup row per game."""
    order = sequence if sequence in lookup.columns else "game_id"
    one = scale.keep_first(lookup, ["game_id"], order).select("game_id", *columns)
    return scale.lookup_join(df, one, ["game_id"])
