"""Event rows -> running game state, per-game results and build issues, for all games at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import exprs as X
from tidemark.operators import scale

GAME = ["game_id"]
EVENT_KEY = ["game_id", "event_num"]
META = ["season", "game_date", "home_team", "away_team"]
RESULT_SOURCE = "play_by_play"  # fixed value

ISSUE_TEXT = {  # fixed values
    "duplicate_events": "Duplicate game_id + event_num rows removed (kept last).",
    "missing_from_games": "game_id present in play_by_play.csv but not in games.csv; "
    "team IDs unavailable.",
    "missing_scores": "No usable scores in play-by-play; final result and "
    "home_team_won could not be determined.",
    "invalid_pctimestring": "One or more pctimestring values could not be parsed.",
}


def dedupe_events(plays: DataFrame, sequence: str = "_seq") -> DataFrame:
    """Latest row per (game, event number); events without a number count as one event."""
    return scale.keep_last(plays, EVENT_KEY, sequence)


def duplicate_count(plays: DataFrame) -> DataFrame:
    """How many rows the dedupe removes."""
    per_event = plays.groupBy(*EVENT_KEY).agg(F.count(F.lit(1)).alias("_n"))
    return per_event.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("removed"))


def with_raw_scores(events: DataFrame) -> DataFrame:
    return events.withColumns({
        "_home_raw": X.number("scoreHome"),
        "_away_raw": X.number("scoreAway"),
    })


def _blocks(events: DataFrame, block_rows: int, extra=None) -> tuple[DataFrame, DataFrame]:
    """(rows with their block, one summary row per game and block)."""
    tie = [c for c in ("_seq",) if c in events.columns]
    blocked = scale.with_block(with_raw_scores(events), GAME, "event_num", tie, block_rows)
    aggs = {"_h": F.max("_home_raw"), "_a": F.max("_away_raw"), **(extra or {})}
    return blocked, scale.block_summary(blocked, GAME, aggs)


def _carried() -> list[Column]:
    """State of a game before each of its blocks."""
    before = scale.blocks_before(GAME)
    return [
        F.coalesce(F.max("_h").over(before), F.lit(0.0)).alias("_h0"),
        F.coalesce(F.max("_a").over(before), F.lit(0.0)).alias("_a0"),
        F.count(F.lit(1)).over(before).alias("_blocks_before"),
    ]


def _run(blocked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Join the carried state onto the rows and finish the running score inside each block."""
    rows = scale.join_blocks(blocked, blocks, GAME)
    inside = scale.inside_block(GAME)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({
        "home_score": F.greatest(F.max("_home_raw").over(so_far), F.col("_h0")),
        "away_score": F.greatest(F.max("_away_raw").over(so_far), F.col("_a0")),
    })
    total = F.col("home_score") + F.col("away_score")
    carried_total = F.when(F.col("_blocks_before") > 0, F.col("_h0") + F.col("_a0"))
    rows = rows.withColumn("_last_total", F.coalesce(F.lag(total).over(inside), carried_total))
    margin = F.col("home_score") - F.col("away_score")
    return rows.withColumns({
        "score_margin_home": margin,
        "abs_score_margin": F.abs(margin),
        "is_scoring_event": F.coalesce(total > F.col("_last_total"), F.lit(False)),
    }).drop("_home_raw", "_away_raw", "_h0", "_a0", "_blocks_before", "_last_total", scale.BLOCK, scale.SLOT)


def running_scores(events: DataFrame, block_rows: int = scale.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Running score per game that never goes back, margins and the scoring flag.

    Expects one row per event. Scores missing before the first one count as 0. Game totals
    walk over block summaries; rows only look inside their own block.
    """
    blocked, blocks = _blocks(events, block_rows)
    return _run(blocked, blocks.select(*GAME, scale.BLOCK, *_carried()))


def _first_meta() -> Column:
    return F.min_by(F.struct(*META), F.coalesce(F.col("event_num"), F.lit(float("inf"))))


def _stamp(played: DataFrame, games: DataFrame, sequence: str) -> DataFrame:
    """Game metadata, final score and label for rows with game totals ``_h``, ``_a``, ``_first``.

    The schedule supplies metadata; a game it does not know keeps that of its first event.
    """
    order = [sequence] if sequence in games.columns else ["game_date"]
    wanted = [*META, "home_team_id", "away_team_id"]
    schedule = scale.keep_last(games, GAME, *order).select(
        *GAME, F.struct(*wanted).alias("_schedule")
    )
    both = played.join(schedule, GAME, "left")
    known = F.col("_schedule").isNotNull()
    scored = F.col("_h").isNotNull() & F.col("_a").isNotNull()
    home, away = (F.when(scored, F.greatest(F.col(c), F.lit(0.0))) for c in ("_h", "_a"))
    return both.withColumns({
        **{c: F.when(known, F.col(f"_schedule.{c}")).otherwise(F.col(f"_first.{c}")) for c in META},
        **{c: F.col(f"_schedule.{c}") for c in ("home_team_id", "away_team_id")},
        "final_home": home, "final_away": away, "in_schedule": known,
        "home_team_won": X.home_won_tie_is_away(home, away),
    }).drop("_schedule", "_first", "_h", "_a")


def game_table(events: DataFrame, games: DataFrame, sequence: str = "_seq") -> DataFrame:
    """One row per played game: metadata, final scores and label.

    The final score is the highest score seen, so a stale trailing row cannot rewind it.
    """
    played = with_raw_scores(events).groupBy(*GAME).agg(
        F.max("_home_raw").alias("_h"), F.max("_away_raw").alias("_a"),
        F.count(F.lit(1)).alias("event_rows"), _first_meta().alias("_first"),
        F.count_if(X.clock_unparsed("pctimestring")).alias("bad_clocks"),
    )
    return _stamp(played, games, sequence)


def game_results(table: DataFrame) -> DataFrame:
    """Results of the games with usable scores; nothing is made up for the others."""
    won = F.col("home_team_won")
    return table.filter(won.isNotNull()).select(
        "game_id", "season", "game_date", "home_team", "away_team",
        "home_team_id", "away_team_id",
        F.col("final_home").alias("home_score"), F.col("final_away").alias("away_score"),
        F.when(won == 1, F.col("home_team")).otherwise(F.col("away_team")).alias("winner"),
        "home_team_won", F.lit(RESULT_SOURCE).alias("source"),
    )


def _issue(df: DataFrame, kind: str, count: str, game_id="game_id") -> DataFrame:
    return df.select(
        X.as_col(game_id).alias("game_id"), F.lit(kind).alias("issue_type"),
        F.lit(ISSUE_TEXT[kind]).alias("message"), F.col(count).cast("long").alias("row_count"),
    )


def build_issues(plays: DataFrame, table: DataFrame) -> DataFrame:
    """Everything the feature build had to work around, counted per game.

    ``table`` has one row per game and is stored; what the dedupe removed is the rows of ``plays``
    that the games do not count.
    """
    table = scale.stored(table)
    kept = table.agg(F.coalesce(F.sum("event_rows"), F.lit(0)).alias("kept")).head().kept
    removed = plays.agg((F.count(F.lit(1)) - F.lit(kept)).alias("removed")).filter("removed > 0")
    return (
        _issue(removed, "duplicate_events", "removed", F.lit(""))
        .unionByName(_issue(table.filter(~F.col("in_schedule")), "missing_from_games", "event_rows"))
        .unionByName(_issue(table.filter("home_team_won IS NULL"), "missing_scores", "event_rows"))
        .unionByName(_issue(table.filter("bad_clocks > 0"), "invalid_pctimestring", "bad_clocks"))
    )


def add_time_and_labels(rows: DataFrame) -> DataFrame:
    """Clock, label and flag columns; shared text work is done once, in a column of its own."""
    rows = rows.withColumns({
        "seconds_remaining_period": X.clock_seconds("pctimestring"),
        "_key": X.event_key("event_msg_type"),
    })
    rows = rows.withColumns({
        "seconds_remaining_game": X.game_seconds_left("period", "seconds_remaining_period"),
        "event_type_label": X.label_of_key("_key", "event_msg_action_type"),
    })
    return rows.withColumns(X.event_flags("event_type_label")).drop("_key")


def live_features(
    events: DataFrame, games: DataFrame, sequence: str = "_seq",
    block_rows: int = scale.DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """The event-level feature table; metadata and label ride along with the block summaries."""
    blocked, blocks = _blocks(events, block_rows, {"_first": _first_meta()})
    game = scale.all_blocks(GAME)
    blocks = blocks.select(
        *GAME, scale.BLOCK, *_carried(),
        *[F.max(c).over(game).alias(c) for c in ("_h", "_a")],
        F.min_by("_first", scale.BLOCK).over(game).alias("_first"),
    )
    stamped = _stamp(blocks, games, sequence).drop("final_home", "final_away", "in_schedule")
    plain = blocked.drop(*META, "home_team_id", "away_team_id", "home_team_won")
    return add_time_and_labels(_run(plain, stamped)).select(*schemas.LIVE_COLUMNS)


def build_live(
    plays: DataFrame, games: DataFrame, sequence: str = "_seq",
    block_rows: int = scale.DEFAULT_BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, results, issues) from raw plays and the schedule; events and games are stored
    once and read by all three."""
    events = scale.stored(dedupe_events(plays, sequence))
    table = scale.stored(game_table(events, games, sequence))
    return (
        live_features(events, games, sequence, block_rows),
        game_results(table),
        build_issues(plays, table),
    )
