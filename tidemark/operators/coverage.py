"""How complete the data is: per-season coverage, training readiness, dataset profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import scale, series

GAMES_WANTED = 1000  # fixed values
RATIO_WANTED = 0.95
MIN_GAMES = 100
MIN_LIVE_ROWS = 10_000
TARGET = "home_team_won"
CRITICAL = ["games", "play_by_play", "live_features", "game_results", "pregame_features"]
TRAINING_SECTIONS = ["play_by_play", "live_features", "pregame_features"]
STATUS_PRIORITY = {
    "missing": 0, "stale": 1, "warning": 2, "unknown": 3, "ok": 4, "not_required": 5,
}
CHECK_PRIORITY = {"fail": 0, "warning": 1, "pass": 2, "not_applicable": 3}
COVERAGE_COLUMNS = [
    "section", "season", "expected_games", "available_games", "available_rows",
    "coverage_pct", "status", "notes", "recommended_action",
]


# ---- counts -------------------------------------------------------------------------------
def season_counts(df: DataFrame) -> DataFrame:
    """Rows and distinct games per season; rows without a season are a group of their own."""
    per_game = df.groupBy("season", "game_id").agg(F.count(F.lit(1)).alias("_n"))
    return per_game.groupBy("season").agg(
        F.sum("_n").alias("row_count"), F.count("game_id").alias("game_count")
    )


def season_report(df: DataFrame) -> DataFrame:
    """Seasons in a table with their sizes and whether the label is well formed."""
    return season_counts(df).withColumn("valid_label", X.season_is_valid("season"))


def events_per_game(plays: DataFrame) -> DataFrame:
    return plays.filter("game_id IS NOT NULL").groupBy("game_id").agg(
        F.count(F.lit(1)).alias("event_rows")
    )


def collection_coverage(games: DataFrame, per_game: DataFrame, generated_at: Column) -> DataFrame:
    """Eligible and collected games, what remains, and event rows per season."""
    eligible = games.select("season", "game_id").distinct()
    found = per_game.select("game_id", "event_rows")
    rows = eligible.join(found, "game_id", "left").groupBy("season").agg(
        F.count(F.lit(1)).alias("eligible_games"),
        F.count("event_rows").alias("collected_games"),
        F.coalesce(F.sum("event_rows"), F.lit(0)).alias("total_event_rows"),
    )
    left = F.col("eligible_games") - F.col("collected_games")
    return rows.select(
        "season", "eligible_games", "collected_games",
        F.greatest(left, F.lit(0)).alias("remaining_games"),
        X.coverage_pct("collected_games", "eligible_games").alias("coverage_pct"),
        "total_event_rows", generated_at.alias("generated_at"),
    )


# ---- coverage over datasets ---------------------------------------------------------------
def _requested(spark: SparkSession, seasons: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(s,) for s in seasons], "season string")


def _ratio_status(available: Column, expected: Column) -> Column:
    return (
        F.when(expected <= 0, "fail")
        .when(available / expected >= RATIO_WANTED, "pass")
        .when(available > 0, "warning")
        .otherwise("fail")
    )


def coverage_report(
    spark: SparkSession, seasons: Sequence[str], datasets: Mapping[str, DataFrame | None]
) -> DataFrame:
    """One row per section and requested season; ``games`` sets what is expected of the others.

    Counts of all tables, a row per table and season, are stored by one job while the report is built.
    """
    wanted = _requested(spark, seasons)
    none = spark.createDataFrame([], "season string, row_count long, game_count long, section string")
    found = [season_counts(df).withColumn("section", F.lit(n)) for n, df in datasets.items() if df is not None]
    held = scale.stored(reduce(DataFrame.unionByName, [none, *found]))
    counts = {n: held.filter(F.col("section") == n).drop("section") for n in datasets}
    expected = counts["games"].select("season", F.col("game_count").alias("expected_games"))
    zero = {"row_count": 0, "game_count": 0, "expected_games": 0}
    parts = []
    for name, table in counts.items():
        rows = wanted.join(table, "season", "left").join(expected, "season", "left").fillna(zero)
        have, want, n = F.col("game_count"), F.col("expected_games"), F.col("row_count")
        unit = " event rows)" if name == "play_by_play" else " rows)"
        if name == "games":
            status = F.when(have >= GAMES_WANTED, "pass").when(have > 0, "warning").otherwise("fail")
            notes = F.concat(have.cast("string"), F.lit(" unique games in games.csv"))
            action = (
                F.when(status == "fail", "Collect game schedule for this season")
                .when(status == "warning", f"Expected at least {GAMES_WANTED} games; "
                      "verify schedule collection").otherwise("")
            )
        else:
            status = _ratio_status(have, want)
            notes = F.when(
                want <= 0, "No expected games — games.csv lacks this season"
            ).otherwise(F.concat(
                have.cast("string"), F.lit("/"), want.cast("string"), F.lit(" games ("),
                n.cast("string"), F.lit(unit),
            ))
            first = "Collect play-by-play for this season, then rebuild the feature tables"
            action = (
                F.when(want <= 0, "Collect game schedule before this dataset")
                .when(status != "pass", first).otherwise("")
            )
        if datasets[name] is None:
            notes = F.lit(f"{name} missing")
        parts.append(rows.select(
            F.lit(name).alias("section"), "season", want.alias("expected_games"),
            have.alias("available_games"), n.alias("available_rows"),
            X.coverage_pct(have, want).alias("coverage_pct"), status.alias("status"),
            notes.alias("notes"), action.alias("recommended_action"),
        ))
    return reduce(DataFrame.unionByName, parts)


def readiness_row(report: DataFrame, train: Sequence[str], test: str) -> DataFrame:
    """One readiness row: no failing section in any season the split needs; warnings pass."""
    spark = report.sparkSession
    needed = [*train, test]
    critical = report.filter(F.col("section").isin(*TRAINING_SECTIONS))
    per_season = critical.groupBy("season").agg(
        F.max((F.col("status") == "fail").cast("int")).alias("_fail")
    )
    state = _requested(spark, needed).join(per_season, "season", "left")
    bad = F.coalesce(F.col("_fail"), F.lit(1)) == 1
    folded = state.agg(
        F.count_if(bad).alias("_bad"),
        F.array_join(F.array_sort(F.collect_list(
            F.when(bad, F.concat(F.col("season"), F.lit(": incomplete")))
        )), "; ").alias("_detail"),
    )
    ok = F.col("_bad") == 0
    zero = F.lit(0).cast("long")
    return folded.select(
        F.lit("readiness").alias("section"),
        F.lit(f"train={','.join(train)};test={test}").alias("season"),
        F.lit(len(needed)).cast("long").alias("expected_games"), zero.alias("available_games"),
        zero.alias("available_rows"), F.lit(0.0).alias("coverage_pct"),
        F.when(ok, "pass").otherwise("fail").alias("status"),
        F.when(ok, f"Coverage sufficient for train {list(train)} / test {test}")
        .otherwise(F.col("_detail")).alias("notes"),
        F.when(ok, "Run the readiness check, then train the multi-season models")
        .otherwise("Complete play-by-play collection and rebuild features before training")
        .alias("recommended_action"),
    )


def missing_seasons(report: DataFrame) -> DataFrame:
    bad = report.filter(F.col("section").isin(*CRITICAL) & (F.col("status") == "fail"))
    return bad.select("season").distinct()


def coverage_allows_training(report: DataFrame) -> DataFrame:
    """Single row ``allowed``: the readiness row decides; without one, no critical failure."""
    ready, status = F.col("section") == "readiness", F.col("status")
    folded = report.agg(
        F.max(F.when(ready, status)).alias("_ready"), F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("section").isin(*CRITICAL) & (status == "fail")).alias("_bad"),
    )
    undecided = F.coalesce(F.col("_ready"), F.lit("not_applicable")) == "not_applicable"
    allowed = (
        F.when(F.col("_rows") == 0, False)
        .when(F.col("_ready") == "pass", True)
        .when(undecided, F.col("_bad") == 0)
        .otherwise(False)
    )
    return folded.select(allowed.alias("allowed"))


# ---- training readiness ---------------------------------------------------------------------
def training_profile(df: DataFrame) -> DataFrame:
    """Per season: rows, games and rows without a target, in one pass."""
    missing = F.col(TARGET).isNull().cast("long")
    per_game = df.groupBy("season", "game_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(missing).alias("_missing")
    )
    return per_game.groupBy("season").agg(
        F.sum("_n").alias("rows"), F.count("game_id").alias("games"),
        F.sum("_missing").alias("missing_target"),
    )


def _dataset_checks(
    df: DataFrame | None, name: str, section: str, train: Sequence[str], test: str,
    spark: SparkSession, min_games: int, min_rows: int | None,
) -> list[DataFrame]:
    schema = "section string, check string, status string, details string"
    required = ["season", "game_id", TARGET]
    have = set(df.columns) if df is not None else set()
    columns = [
        (section, f"{name}_column_{c}", "pass" if c in have else "fail",
         f"{c} present in {name}" if c in have
         else (f"Missing column '{c}' in {name}" if df is not None else f"{name} not loaded"))
        for c in required
    ]
    exists = (section, f"{name}_exists", "pass" if df is not None else "fail",
              "" if df is not None else f"Table missing: {name}")
    out = [spark.createDataFrame([exists, *columns], schema)]
    if df is None or not have.issuperset(required):
        return out
    sides = spark.createDataFrame(
        [(s, "train") for s in train] + [(test, "test")], "season string, side string"
    )
    rows = sides.join(scale.stored(training_profile(df)), "season", "left")
    found = F.col("rows").isNotNull()
    season = F.col("season")
    n, games = F.coalesce("rows", F.lit(0)), F.coalesce("games", F.lit(0))
    nulls = F.coalesce("missing_target", F.lit(0))

    def check(label: Column, passed: Column, good: Column, bad: Column, only=None) -> DataFrame:
        base = rows if only is None else rows.filter(only)
        return base.select(
            F.lit(section).alias("section"), label.alias("check"),
            F.when(passed, "pass").otherwise("fail").alias("status"),
            F.when(passed, good).otherwise(bad).alias("details"),
        )

    def named(kind: str) -> Column:
        return F.concat(F.lit(f"{name}_{kind}_"), season)

    text = lambda *parts: F.concat(*[
        p if isinstance(p, Column) else F.lit(p) for p in parts
    ])
    out.append(check(named("season"), found, text(season, f" present in {name}"),
                     text(season, f" missing from {name}")))
    out.append(check(
        named("min_games"), games >= min_games,
        text(season, ": ", games.cast("string"), f" games (min {min_games})"),
        text(season, ": ", games.cast("string"), f" games, need at least {min_games}"),
    ))
    if min_rows is not None:
        out.append(check(
            named("min_rows"), n >= min_rows,
            text(season, ": ", n.cast("string"), f" rows (min {min_rows})"),
            text(season, ": ", n.cast("string"), f" rows, need at least {min_rows}"),
        ))
    side = F.col("side")
    out.append(check(
        text(f"{name}_target_", side, "_", season), nulls == 0,
        text(season, ": all ", side, f" rows have {TARGET}"),
        text(season, ": ", nulls.cast("string"), " ", side, f" rows missing {TARGET}"),
        only=found,
    ))
    return out


def training_readiness(
    spark: SparkSession, pregame: DataFrame | None, live: DataFrame | None,
    train: Sequence[str], test: str, min_games: int = MIN_GAMES, min_live_rows: int = MIN_LIVE_ROWS,
) -> DataFrame:
    """Check rows of both feature tables for a train/test season split."""
    if not train or test in train:
        raise ValueError("train and test seasons must be non-empty and disjoint")
    split = spark.createDataFrame(
        [("split", "train_test_no_overlap", "pass", f"Train {list(train)}, test {test}")],
        "section string, check string, status string, details string",
    )
    parts = [split]
    parts += _dataset_checks(
        pregame, "pregame_features", "pregame", train, test, spark, min_games, None
    )
    parts += _dataset_checks(
        live, "live_features", "live", train, test, spark, min_games, min_live_rows
    )
    return reduce(DataFrame.unionByName, parts)


def allows_training(readiness: DataFrame, sections: Sequence[str] | None = None) -> DataFrame:
    """Single row ``allowed``: some check ran in the chosen sections and none failed."""
    rows = readiness if sections is None else readiness.filter(F.col("section").isin(*sections))
    n, bad = F.count(F.lit(1)), F.count_if(F.col("status") == "fail")
    return rows.agg(((n > 0) & (bad == 0)).alias("allowed"))


# ---- playoffs ---------------------------------------------------------------------------------
def playoff_coverage(games: DataFrame, plays: DataFrame, shown: int = 5) -> DataFrame:
    """Per season: playoff games, how many have events, and the first few that do not."""
    rows = series.playoff_games(games).select("season", "game_id")
    events = plays.select("game_id").dropna().distinct().withColumn("_has", F.lit(True))
    rows = rows.join(events, "game_id", "left")
    counts = rows.groupBy("season").agg(
        F.count(F.lit(1)).alias("playoff_games"), F.count("_has").alias("games_with_pbp")
    )
    absent = rows.filter("_has IS NULL")
    few = scale.top_per_key(absent, ["season"], [F.col("game_id").asc()], shown)
    few = few.groupBy("season").agg(
        F.array_join(F.array_sort(F.collect_list("game_id")), ", ").alias("_ids")
    )
    finals = series.final_series_games(games).groupBy("season").agg(
        F.count(F.lit(1)).alias("_finals")
    )
    out = counts.join(few, "season", "left").join(finals, "season", "left")
    missing = F.col("playoff_games") - F.col("games_with_pbp")
    more = F.when(missing > shown, "...").otherwise("")
    return out.select(
        "season", "playoff_games", "games_with_pbp",
        X.coverage_pct("games_with_pbp", "playoff_games", 1).alias("pbp_coverage_pct"),
        F.coalesce("_finals", F.lit(0)).alias("finals_games_detected"),
        missing.alias("missing_pbp_games"),
        F.concat(F.lit("missing: "), F.coalesce("_ids", F.lit("")), more).alias("notes"),
    )


def export_gaps(export: DataFrame, report: DataFrame) -> DataFrame:
    """Replay-available games that the export lacks, with padded ids on both sides."""
    exported = export.select(X.pad_id("game_id").alias("game_id")).distinct()
    wanted = report.filter("replay_available").select(X.pad_id("game_id").alias("game_id"))
    return wanted.distinct().join(exported, "game_id", "left_anti")


def export_check(export: DataFrame, report: DataFrame) -> DataFrame:
    """Status of the export: empty fails, gaps warn."""
    size = export.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("game_id").alias("games")
    ).withColumn("_k", F.lit(1))
    gaps = export_gaps(export, report).agg(F.count(F.lit(1)).alias("missing_games"))
    both = size.join(gaps.withColumn("_k", F.lit(1)), "_k").drop("_k")
    status = (
        F.when(F.col("rows") == 0, "fail").when(F.col("missing_games") > 0, "warning")
        .otherwise("pass")
    )
    return both.withColumn("status", status)


# ---- dataset profiles ------------------------------------------------------------------------
def dataset_profile(
    spark: SparkSession, datasets: Mapping[str, DataFrame | None],
    game_column: Mapping[str, str | None], changed_column: Mapping[str, str | None],
    required: Sequence[str] = (), depends_on: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Rows, distinct games, latest change and status per registered table.

    A table is stale when any table it depends on changed after it did.
    """
    schema = "asset string, row_count long, unique_games long, last_changed timestamp, present boolean"
    absent = [(n, None, None, None, False) for n, df in datasets.items() if df is None]
    parts = [spark.createDataFrame(absent, schema)]
    for name, df in datasets.items():
        if df is None:
            continue
        game, changed = game_column.get(name), changed_column.get(name)
        games = F.countDistinct(game) if game else F.lit(None).cast("long")
        latest = F.max(F.col(changed).cast("timestamp")) if changed else F.lit(None).cast("timestamp")
        parts.append(df.agg(
            F.count(F.lit(1)).alias("row_count"), games.alias("unique_games"),
            latest.alias("last_changed"),
        ).select(F.lit(name).alias("asset"), "*", F.lit(True).alias("present")))
    profile = scale.stored(reduce(DataFrame.unionByName, parts))  # a row per table
    must = F.col("asset").isin(*required) if required else F.lit(False)
    status = (
        F.when(~F.col("present"), F.when(must, "missing").otherwise("not_required"))
        .when(F.col("row_count") == 0, "warning")
        .otherwise("ok")
    )
    profile = profile.withColumn("status", status)
    links = [(a, d) for a, ds in (depends_on or {}).items() for d in ds]
    if links:
        newest = profile.select(F.col("asset").alias("dep"), F.col("last_changed").alias("_dep"))
        needs = spark.createDataFrame(links, "asset string, dep string").join(newest, "dep")
        needs = needs.groupBy("asset").agg(F.max("_dep").alias("_dep"))
        profile = profile.join(needs, "asset", "left")
        stale = F.col("status").isin("ok", "warning") & (F.col("_dep") > F.col("last_changed"))
        profile = profile.withColumn(
            "status", F.when(stale, "stale").otherwise(F.col("status"))
        ).drop("_dep")
    return profile.select("asset", "status", "row_count", "unique_games", "last_changed")


def _priority(column: str, table: Mapping[str, int]) -> Column:
    rank = reduce(lambda w, kv: w.when(F.col(column) == kv[0], kv[1]), table.items(),
                  F.when(F.col(column).isNull(), 99))
    return rank.otherwise(99)


def status_counts(df: DataFrame, table: Mapping[str, int] = STATUS_PRIORITY) -> DataFrame:
    """Count per known status, zeros included."""
    base = df.sparkSession.createDataFrame([(s,) for s in table], "status string")
    counts = df.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return base.join(counts, "status", "full").fillna({"n": 0})


def overall_status(df: DataFrame, table: Mapping[str, int] = STATUS_PRIORITY) -> DataFrame:
    """Most severe status present; a table where all is well says so."""
    best = [s for s in ("ok", "pass") if s in table][0]
    fine = {best, "not_required", "not_applicable"}
    worst = F.min_by("status", _priority("status", table))
    none = "unknown" if best == "ok" else "fail"
    picked = df.agg(worst.alias("status"), F.count(F.lit(1)).alias("_n"))
    return picked.select(
        F.when(F.col("_n") == 0, none)
        .when(F.col("status").isin(*fine), best)
        .otherwise(F.col("status")).alias("overall_status")
    )


def top_issues(
    df: DataFrame, names: Sequence[str], limit: int = 5, table: Mapping[str, int] = STATUS_PRIORITY,
    bad: Sequence[str] = ("missing", "stale", "warning"),
) -> DataFrame:
    """The most severe problems first."""
    rows = df.filter(F.col("status").isin(*bad))
    return rows.orderBy(_priority("status", table), *names).limit(limit)


def freshness_check(profile: DataFrame) -> DataFrame:
    """The whole profile folded to pass, warning or fail."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    folded = profile.agg(
        count("missing").alias("missing"), count("stale", "warning").alias("warnings"),
        F.count(F.lit(1)).alias("assets"),
    )
    status = (
        F.when(F.col("missing") > 0, "fail").when(F.col("warnings") > 0, "warning")
        .otherwise("pass")
    )
    return folded.withColumn("status", status)
