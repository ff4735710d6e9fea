"""Leakage-safe pre-game features: a game only sees strictly earlier dates of its season."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import exprs as X
from tidemark.operators import scale

NEUTRAL_PCT = 0.5
DEFAULT_REST = 3.0
RECENT_GAMES = 5
TEAM_DAY = ["team_id", "season", "day"]
STATS = [
    "games_played_before", "wins_before", "losses_before", "win_pct_before",
    "points_for_avg_before", "points_allowed_avg_before", "recent_win_pct_before", "rest_days",
]
MISSING_TARGET = (  # fixed value
    "home_team_won could not be computed (no usable score columns in games.csv). "
    "Row kept for non-target features only."
)


def final_games(games: DataFrame, season: str | None = None, any_case: bool = False) -> DataFrame:
    """Completed games with an id, a date and both teams; the status match is exact by default."""
    status = F.lower("status") if any_case else F.col("status")
    out = games.filter(status == "final").dropna(
        subset=["game_id", "game_date", "home_team_id", "away_team_id"]
    )
    return out if season is None else out.filter(F.col("season") == season)


def score_columns(df: DataFrame) -> tuple[str, str] | None:
    """First known (home, away) score pair that is complete in this table."""
    present = set(df.columns)
    return next((p for p in schemas.SCORE_COLUMN_PAIRS if present.issuperset(p)), None)


def merge_results(games: DataFrame, results: DataFrame | None, sequence: str = "_seq") -> DataFrame:
    """Left join final scores; the last result row per game counts and old scores are dropped.

    Without results, or where they hold no pair of scores, the games stay as they are: features then
    rest on dates alone and have no label.
    """
    if results is None:
        return games
    wanted = [c for c in ("game_id", "home_score", "away_score", "home_team_won")
              if c in results.columns]
    if len(wanted) < 3 or "game_id" not in wanted:
        return games
    order = sequence if sequence in results.columns else "game_id"
    latest = scale.keep_last(results, ["game_id"], order).select(*wanted)
    return games.drop(*wanted[1:]).join(latest, "game_id", "left")


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.unix_date(F.col("game_date").try_cast("date")))


def team_history(games: DataFrame) -> DataFrame:
    """Two rows per game, one per team, from a single pass over the games."""
    pair = score_columns(games)
    none = F.lit(None).cast("double")
    home_pts, away_pts = (X.number(c) for c in pair) if pair else (none, none)
    won = X.home_won_or_null(home_pts, away_pts).cast("double")

    def side(team, is_home, result, points, allowed):
        return F.struct(
            F.col(team).alias("team_id"), F.lit(is_home).alias("is_home"), result.alias("won"),
            points.alias("points_for"), allowed.alias("points_allowed"),
        )

    sides = F.array(
        side("home_team_id", True, won, home_pts, away_pts),
        side("away_team_id", False, 1.0 - won, away_pts, home_pts),
    )
    return (
        with_day(games)
        .select("game_id", "season", "game_date", "day", F.inline(sides))
    )


def daily_form(history: DataFrame, recent: int = RECENT_GAMES) -> DataFrame:
    """Everything later days need to know about one team's day: sums, and its last few games."""
    dated = history.filter(F.col("day").isNotNull() & F.col("season").isNotNull())
    sums = dated.groupBy(*TEAM_DAY).agg(
        F.count(F.lit(1)).alias("_games"),
        F.count_if(F.col("won") == 1).alias("_wins"),
        F.count_if(F.col("won") == 0).alias("_losses"),
        F.sum("points_for").alias("_for"), F.count("points_for").alias("_for_n"),
        F.sum("points_allowed").alias("_against"), F.count("points_allowed").alias("_against_n"),
    )
    newest = [F.col("game_id").desc(), F.col("is_home").asc()]
    last = scale.top_per_key(dated, TEAM_DAY, newest, recent)
    entry = F.struct("game_id", (~F.col("is_home")).alias("away"), "won")
    last = last.groupBy(*TEAM_DAY).agg(F.array_sort(F.collect_list(entry)).alias("_last"))
    return sums.join(last, TEAM_DAY)


def form_before(history: DataFrame, recent: int = RECENT_GAMES) -> DataFrame:
    """Strictly-prior statistics per team, season and day.

    Days are summed first, so the windows below hold at most one row per team and calendar day
    however many games a day has.
    """
    team = Window.partitionBy("team_id", "season").orderBy("day")
    prior = team.rowsBetween(Window.unboundedPreceding, -1)
    lately = team.rowsBetween(-recent, -1)
    sums = ("_games", "_wins", "_losses", "_for", "_for_n", "_against", "_against_n")
    rows = daily_form(history, recent).select(
        *TEAM_DAY,
        *[F.sum(c).over(prior).alias(c) for c in sums],
        F.max("day").over(prior).alias("_last_day"),
        F.flatten(F.collect_list("_last").over(lately)).alias("_recent"),
    )
    rows = rows.withColumn(
        "_recent",
        F.slice("_recent", F.greatest(F.size("_recent") - (recent - 1), F.lit(1)), recent),
    ).withColumn("_known", F.filter(F.col("_recent.won"), lambda w: w.isNotNull()))
    played = F.coalesce(F.col("_games"), F.lit(0))
    decided = F.col("_wins") + F.col("_losses")
    wins = F.aggregate("_known", F.lit(0.0), lambda a, w: a + w)
    outcome = lambda c: F.when(played == 0, F.lit(0)).when(decided > 0, F.col(c))
    return rows.select(
        *TEAM_DAY,
        played.alias("games_played_before"),
        outcome("_wins").alias("wins_before"),
        outcome("_losses").alias("losses_before"),
        F.coalesce(F.try_divide("_wins", decided), F.lit(NEUTRAL_PCT)).alias("win_pct_before"),
        F.try_divide("_for", "_for_n").alias("points_for_avg_before"),
        F.try_divide("_against", "_against_n").alias("points_allowed_avg_before"),
        F.when(F.size("_known") > 0, wins / F.size("_known"))
        .otherwise(NEUTRAL_PCT).alias("recent_win_pct_before"),
        (F.col("day") - F.col("_last_day")).cast("double").alias("rest_days"),
    )


def attach_form(games: DataFrame, form: DataFrame) -> DataFrame:
    """Add the home and away statistics of the game's own date."""

    def add(df: DataFrame, side: str) -> DataFrame:
        side_form = form.select(
            F.col("team_id").alias(f"{side}_team_id"), "season", "day",
            *[F.col(c).alias(f"{side}_{c}") for c in STATS],
        )
        return scale.lookup_join(
            df, side_form, [f"{side}_team_id", "season", "day"]
        )

    out = reduce(add, ("home", "away"), with_day(games))
    fills = {}
    for side in ("home", "away"):
        found = F.col(f"{side}_games_played_before").isNotNull()
        for c in ("games_played_before", "wins_before", "losses_before"):
            value = F.when(found, F.col(f"{side}_{c}")).otherwise(F.lit(0))
            fills[f"{side}_{c}"] = value.cast("long")
        for c in ("win_pct_before", "recent_win_pct_before"):
            fills[f"{side}_{c}"] = F.coalesce(F.col(f"{side}_{c}"), F.lit(NEUTRAL_PCT))
        fills[f"{side}_rest_days"] = F.coalesce(F.col(f"{side}_rest_days"), F.lit(DEFAULT_REST))
    return out.withColumns(fills).drop("day")


def add_differences(df: DataFrame) -> DataFrame:
    """Home minus away, taken after the fallbacks are in."""
    pairs = {
        "win_pct_diff_before": "win_pct_before",
        "points_for_avg_diff_before": "points_for_avg_before",
        "points_allowed_avg_diff_before": "points_allowed_avg_before",
        "recent_win_pct_diff_before": "recent_win_pct_before",
        "rest_days_diff": "rest_days",
    }
    return df.withColumns({n: F.col(f"home_{c}") - F.col(f"away_{c}") for n, c in pairs.items()})


def pregame_features(
    games: DataFrame, recent: int = RECENT_GAMES, targets: DataFrame | None = None
) -> DataFrame:
    """Feature rows for ``targets`` (default: all ``games``) with ``games`` as the history."""
    form = form_before(team_history(games), recent)
    rows = games if targets is None else games.join(
        targets.select("game_id").distinct(), "game_id", "left_semi"
    )
    pair = score_columns(rows)
    target = X.home_won_or_null(*pair) if pair else F.lit(None).cast("int")
    rows = rows.withColumn("home_team_won", target)
    if "game_type" not in rows.columns:
        rows = rows.withColumn("game_type", F.lit(None).cast("string"))
    return add_differences(attach_form(rows, form)).select(*schemas.PREGAME_COLUMNS)


def pregame_issues(features: DataFrame) -> DataFrame:
    return features.filter("home_team_won IS NULL").select(
        "game_id", F.lit("missing_target").alias("issue_type"),
        F.lit(MISSING_TARGET).alias("message"),
    )


def combine_history(
    regular: DataFrame, playoffs: DataFrame, targets: DataFrame
) -> DataFrame:
    """Completed games of both kinds without the target games, plus the targets once each."""
    ids = targets.select("game_id").distinct()
    past = regular.unionByName(playoffs, allowMissingColumns=True).join(ids, "game_id", "left_anti")
    past = past.withColumn("_turn", F.lit(0))
    both = past.unionByName(targets.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    order = ["_turn", "_seq"] if "_seq" in both.columns else ["_turn", "game_date"]
    return scale.keep_last(both, ["game_id"], *order).drop("_turn")


def series_pregame_features(
    regular: DataFrame, playoffs: DataFrame, targets: DataFrame, results: DataFrame
) -> DataFrame:
    """Features of series games; only completed targets carry a score, the rest stay open."""
    done = F.lower("status").isin("final", "completed")
    scored = merge_results(targets, results)
    cols = [c for c in ("home_score", "away_score") if c in scored.columns]
    scored = scored.withColumns({c: F.when(done, F.col(c)) for c in cols})
    everything = combine_history(regular, playoffs, scored)
    return pregame_features(everything, targets=targets)
