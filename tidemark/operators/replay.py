"""Replaying scored games: swings, elapsed time, first and last events, catalogs, long views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import exprs as X
from tidemark.operators import scale

# ---- fixed values: display groups ------------------------------------------------
FEATURE_SECTIONS = {
    "Season record before game": {
        "Home games played": "home_games_played_before",
        "Away games played": "away_games_played_before",
        "Home win %": "home_win_pct_before",
        "Away win %": "away_win_pct_before",
        "Win % diff (home)": "win_pct_diff_before",
    },
    "Scoring form before game": {
        "Home pts for avg": "home_points_for_avg_before",
        "Away pts for avg": "away_points_for_avg_before",
        "Pts for diff (home)": "points_for_avg_diff_before",
        "Home pts allowed avg": "home_points_allowed_avg_before",
        "Away pts allowed avg": "away_points_allowed_avg_before",
        "Pts allowed diff (home)": "points_allowed_avg_diff_before",
    },
    "Recent form": {
        "Home recent win %": "home_recent_win_pct_before",
        "Away recent win %": "away_recent_win_pct_before",
        "Recent win % diff (home)": "recent_win_pct_diff_before",
    },
    "Rest advantage": {
        "Home rest days": "home_rest_days",
        "Away rest days": "away_rest_days",
        "Rest days diff (home)": "rest_days_diff",
    },
}
COMPARED = {
    "Win %": "win_pct_before",
    "Pts for avg": "points_for_avg_before",
    "Pts allowed avg": "points_allowed_avg_before",
    "Recent win %": "recent_win_pct_before",
    "Rest days": "rest_days",
}
# ------------------------------------------------------------------------------------


def with_previous_probability(
    live: DataFrame, block_rows: int = scale.DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """Home win probability of the event before, per game; events of equal number in ingest order
    where the rows have one, else by their probability."""
    tie = [c for c in ("_seq", "home_win_probability") if c in live.columns][:1]
    return scale.add_previous(
        live, ["game_id"], "event_num",
        {"previous_home_win_probability": "home_win_probability"}, tie=tie, block_rows=block_rows,
    )


def biggest_swings(
    live: DataFrame, top_n: int = 50, block_rows: int = scale.DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """Largest probability changes over all games; a first event has no change."""
    rows = with_previous_probability(live, block_rows)
    change = F.col("home_win_probability") - F.col("previous_home_win_probability")
    rows = rows.withColumns({
        "probability_change": change, "absolute_probability_change": F.abs(change),
    }).filter("previous_home_win_probability IS NOT NULL")
    columns = [c for c in schemas.SWING_COLUMNS if c in rows.columns]
    best = F.col("absolute_probability_change").desc_nulls_last()
    return rows.select(*columns).orderBy(best, "game_id", "event_num").limit(top_n)


def add_replay_columns(
    live: DataFrame, block_rows: int = scale.DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """Elapsed seconds since the start of each game and the change at every event (first: 0)."""
    start = live.groupBy("game_id").agg(F.max("seconds_remaining_game").alias("_start"))
    start = start.withColumnRenamed("game_id", "_id")
    rows = live.join(start, F.col("game_id").eqNullSafe(F.col("_id"))).drop("_id")
    rows = with_previous_probability(rows, block_rows)
    change = F.coalesce(
        F.col("home_win_probability") - F.col("previous_home_win_probability"), F.lit(0.0)
    )
    return rows.withColumns({
        "game_elapsed_seconds": F.col("_start") - F.col("seconds_remaining_game"),
        "probability_change": change, "absolute_probability_change": F.abs(change),
    }).drop("_start", "previous_home_win_probability")


def top_swings_per_game(
    live: DataFrame, n: int = 10, block_rows: int = scale.DEFAULT_BLOCK_ROWS
) -> DataFrame:
    rows = add_replay_columns(live, block_rows)
    best = [F.col("absolute_probability_change").desc_nulls_last(), F.col("event_num").asc()]
    return scale.top_per_key(rows, ["game_id"], best, n)


def _edge_event(df: DataFrame, columns: Sequence[str], last: bool, order: Sequence[Column],
                keys: Sequence[str]) -> DataFrame:
    pick = F.max_by if last else F.min_by
    row = pick(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*")


def final_events(live: DataFrame, sequence: str | None = None) -> DataFrame:
    """Row with the highest event number per game; the first one on ties, in ingest order where
    the rows have it, else the one whose values sort first."""
    rows = live.filter(X.number("event_num").isNotNull())
    sequence = sequence or ("_seq" if "_seq" in live.columns else None)
    order = [F.col("event_num")] + ([-F.col(sequence)] if sequence else [])
    columns = [c for c in live.columns if c != "game_id"]
    return _edge_event(rows, columns, True, order, ["game_id"])


def first_and_last(
    df: DataFrame, columns: Sequence[str], order: Sequence[str] = ("event_num",),
    keys: Sequence[str] = ("game_id",),
) -> DataFrame:
    """``<column>_start`` and ``<column>_final`` per key, one pass with partial aggregation."""
    position = F.struct(*order)
    row = F.struct(*columns)
    edges = df.groupBy(*keys).agg(
        F.min_by(row, position).alias("_a"), F.max_by(row, position).alias("_b")
    )
    return edges.select(
        *keys, *[F.col(f"_a.{c}").alias(f"{c}_start") for c in columns],
        *[F.col(f"_b.{c}").alias(f"{c}_final") for c in columns],
    )


# ---- catalogs -----------------------------------------------------------------------------
def games_catalog(predictions: DataFrame, sequence: str = "event_num") -> DataFrame:
    """One labelled row per game."""
    columns = ["game_id", "season", "game_date", "home_team", "away_team"]
    one = scale.keep_first(predictions, ["game_id"], sequence).select(*columns)
    return one.withColumn("label", X.game_label())


def filter_catalog(
    catalog: DataFrame, season: str | None = None, team: str | None = None
) -> DataFrame:
    out = catalog
    if season not in (None, "All seasons"):
        out = out.filter(F.col("season") == season)
    if team not in (None, "All teams"):
        out = out.filter((F.col("home_team") == team) | (F.col("away_team") == team))
    return out


def team_names(predictions: DataFrame) -> DataFrame:
    team = F.explode(F.array("home_team", "away_team")).alias("team")
    return predictions.select(team).dropna().distinct()


def in_catalog(
    predictions: DataFrame, catalog: DataFrame
) -> DataFrame:
    """Predictions of the games in a filtered catalog."""
    ids = catalog.select("game_id").distinct()
    return scale.lookup_join(
        predictions, ids, ["game_id"], how="inner"
    )


# ---- wide to long -------------------------------------------------------------------------
def team_comparison(features: DataFrame) -> DataFrame:
    """(game, metric, team, value) for both sides of every game; missing sides are left out."""
    entries = [
        F.struct(
            F.lit(label).alias("metric"), F.col(f"{side}_team").alias("team"),
            F.col(f"{side}_{column}").cast("double").alias("value"),
        )
        for label, column in COMPARED.items()
        for side in ("home", "away")
        if f"{side}_{column}" in features.columns
    ]
    return features.select("game_id", F.inline(F.array(*entries))).filter("value IS NOT NULL")


def feature_sections(features: DataFrame) -> DataFrame:
    """(game, section, label, value) for display; missing values are left out."""
    entries = [
        F.struct(
            F.lit(section).alias("section"), F.lit(label).alias("label"),
            F.col(column).cast("double").alias("value"),
        )
        for section, fields in FEATURE_SECTIONS.items()
        for label, column in fields.items()
        if column in features.columns
    ]
    return features.select("game_id", F.inline(F.array(*entries))).filter("value IS NOT NULL")
