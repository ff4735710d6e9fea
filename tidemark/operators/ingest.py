"""Landed feed rows -> clean games, events and team statistics, for all seasons at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import exprs as X
from tidemark.operators import quality, scale

LIST_SEPARATOR = " | "  # fixed value
FEED_KEY = ["season", "game_type", "game_id"]
PART_ROWS = 1000


# ---- schedule: two team rows -> one game ----------------------------------------------------
def clean_team_rows(rows: DataFrame) -> DataFrame:
    quality.require_columns(
        rows, ["GAME_ID", "TEAM_ID", "TEAM_NAME", "GAME_DATE", "MATCHUP"], "raw team rows"
    )
    return rows.filter("GAME_ID IS NOT NULL").select(
        "season", X.game_type_of("season_type").alias("game_type"),
        F.col("GAME_ID").cast("string").alias("game_id"),
        F.col("TEAM_ID").cast("string").alias("team_id"),
        F.col("TEAM_NAME").alias("team_name"), F.col("GAME_DATE").cast("string").alias("game_date"),
        F.col("MATCHUP").alias("matchup"), X.matchup_side("MATCHUP").alias("side"), "_seq",
    )


def game_groups(rows: DataFrame) -> DataFrame:
    """One row per feed game: side counts, every reason to skip it, and its home and away entry.

    Counts and one entry per side are kept, so a game with a huge number of copies is combined
    before the shuffle.
    """
    entry = F.struct("game_date", "team_name", "team_id")
    home_row, away_row = F.col("side") == "home", F.col("side") == "away"
    unnamed = X.any_null("team_name", "team_id")
    groups = rows.groupBy(*FEED_KEY).agg(
        F.count(F.lit(1)).alias("raw_row_count"),
        F.count_if(home_row).alias("home_row_count"),
        F.count_if(away_row).alias("away_row_count"),
        F.count_if(F.col("side").isNull()).alias("_unread"),
        F.count_if((home_row & (unnamed | F.col("game_date").isNull())) | (away_row & unnamed))
        .alias("_incomplete"),
        F.max(F.when(home_row, entry)).alias("_home"), F.max(F.when(away_row, entry)).alias("_away"),
    )
    home, away = F.col("home_row_count"), F.col("away_row_count")
    paired = (F.col("_unread") == 0) & (home == 1) & (away == 1)
    reasons = F.array_compact(F.array(
        F.when(F.col("_unread") > 0, "invalid_matchup_format"),
        F.when(home == 0, "missing_home_row"),
        F.when(away == 0, "missing_away_row"),
        F.when(home > 1, "multiple_home_rows"),
        F.when(away > 1, "multiple_away_rows"),
        F.when(paired & (F.col("_incomplete") > 0), "missing_required_fields"),
    ))
    return groups.withColumn("reason_skipped", F.array_join(reasons, ";"))


def pair_games(groups: DataFrame) -> DataFrame:
    """The games with exactly one home and one away row and all required fields."""
    return groups.filter("reason_skipped = ''").select(
        "game_id", "season", F.col("_home.game_date").alias("game_date"),
        F.col("_home.team_name").alias("home_team"), F.col("_away.team_name").alias("away_team"),
        F.col("_home.team_id").alias("home_team_id"), F.col("_away.team_id").alias("away_team_id"),
        F.lit("final").alias("status"), "game_type",
    )


def skipped_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Every feed row of every skipped game, one line each, whatever the size of the game."""
    skipped = groups.filter("reason_skipped != ''").select(
        *FEED_KEY, "raw_row_count", "reason_skipped"
    )
    return scale.lookup_join(rows, skipped, FEED_KEY, how="inner")


def skipped_games(rows: DataFrame, groups: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Skip report with the values of each game listed in a cell.

    A game with more than ``part_rows`` rows is reported in as many parts as that takes, dealt by a
    hash of ``_seq``, so cells stay small and every value is in one of them.
    """
    columns = {
        "team_names": "team_name", "team_ids": "team_id",
        "matchup_values": "matchup", "game_dates": "game_date",
    }
    counts = ["raw_row_count", "home_row_count", "away_row_count", "reason_skipped"]
    skipped = groups.filter("reason_skipped != ''").select(*FEED_KEY, *counts)
    detail = scale.lookup_join(rows, skipped, FEED_KEY, how="inner")
    parts = F.ceil(F.col("raw_row_count") / part_rows)
    detail = detail.withColumn("part", F.pmod(F.xxhash64("_seq"), parts).cast("int"))
    entry = F.struct("_seq", *[
        F.coalesce(F.col(c), F.lit("nan")).alias(c) for c in columns.values()
    ])
    lists = detail.groupBy(*FEED_KEY, *counts, "part").agg(
        F.array_sort(F.collect_list(entry)).alias("_rows"))
    return lists.withColumns({
        n: F.array_join(F.col(f"_rows.{c}"), LIST_SEPARATOR) for n, c in columns.items()
    }).select(*schemas.SKIPPED_COLUMNS, "part")


def raw_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("raw_row_count"),
        F.countDistinct("game_id").alias("unique_game_id_count"),
        F.floor(F.count(F.lit(1)) / 2).alias("expected_game_count_from_raw_pairs"),
    )


# ---- play-by-play -------------------------------------------------------------------------
def normalize_plays(raw: DataFrame, games: DataFrame) -> DataFrame:
    """Feed columns to the event table; game metadata comes from the schedule."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    where = text("location")
    said = lambda at: F.when(where == at, text("description")).otherwise("")
    extras = [c for c in schemas.PLAY_EXTRA_COLUMNS if c in raw.columns]
    keep = [c for c in ("_seq",) if c in raw.columns]
    events = raw.select(
        F.col("gameId").cast("string").alias("game_id"),
        F.col("actionNumber").try_cast("double").alias("event_num"),
        F.col("actionType").alias("event_msg_type"),
        F.col("subType").alias("event_msg_action_type"),
        "period", F.col("clock").alias("pctimestring"),
        said("h").alias("home_description"), said("").alias("neutral_description"),
        said("v").alias("visitor_description"),
        X.score_text("scoreHome", "scoreAway").alias("score"),
        X.score_margin_text("scoreHome", "scoreAway").alias("score_margin"),
        *extras, *keep,
    )
    meta = games.select("game_id", "home_team", "away_team", "season", "game_date")
    meta = scale.keep_last(meta, ["game_id"], "game_date")
    stamped = scale.lookup_join(events, meta, ["game_id"])
    return stamped.select(*schemas.PLAY_COLUMNS, *extras, *keep)


def collected_games(plays: DataFrame) -> DataFrame:
    return plays.select("game_id").dropna().distinct()


def games_to_collect(
    games: DataFrame, collected: DataFrame | None = None,
    game_id: str | None = None, limit: int | None = None,
) -> DataFrame:
    """Games still to fetch: one-game filter first, then skip known ones, then the cap."""
    out = games if game_id is None else games.filter(F.col("game_id") == game_id)
    if collected is not None:
        out = out.join(collected_games(collected), "game_id", "left_anti")
    if limit:
        out = out.orderBy("season", "game_date", "game_id").limit(limit)
    return out


def merge_failures(
    existing: DataFrame | None, new: DataFrame, succeeded: DataFrame, key=("game_id",),
    sequence: str = "_seq",
) -> DataFrame:
    """Failure report after a run: successes leave it, new failures replace old ones."""
    key = list(key)
    latest = scale.keep_last(new, key, sequence)
    if existing is None:
        return latest
    gone = succeeded.select(*key).unionByName(latest.select(*key)).distinct()
    kept = scale.keep_last(existing.join(gone, key, "left_anti"), key, sequence)
    return kept.unionByName(latest, allowMissingColumns=True)


# ---- team statistics ------------------------------------------------------------------------
def normalize_team_stats(raw: DataFrame) -> DataFrame:
    """Feed statistics to the team table; the advanced group is kept only where it was sent."""
    quality.require_columns(raw, schemas.TEAM_STATS_REQUIRED_SOURCE, "raw team stats")
    names = {**schemas.TEAM_STATS_BASE, **schemas.TEAM_STATS_ADVANCED}
    present = [(a, b) for a, b in names.items() if a in raw.columns]
    keep = [c for c in ("_seq",) if c in raw.columns]
    out = raw.select(
        "season", X.season_type_strict("season_type").alias("season_type"),
        *[F.col(a).alias(b) for a, b in present], *keep,
    )
    return out.withColumn("team_id", F.col("team_id").cast("string"))
