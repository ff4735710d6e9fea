"""End-to-end jobs over stored tables: build features, train, predict, evaluate, series reports.

Every job reads Parquet tables under one root folder and writes its results next to them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import (
    coverage, live, metrics, model, pregame, quality, reconcile, replay, scale, series, split,
)
from tidemark.sources import tables


def _sides(df: DataFrame, non_null: Sequence[str], required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Valid and invalid rows, staged by one run of the plan."""
    staged = f"{scale.shared_folder(df.sparkSession)}/split-{uuid.uuid4().hex}"
    return tables.write_split(df, staged, non_null, required)


def build_features(spark: SparkSession, root: str, recent: int = pregame.RECENT_GAMES) -> None:
    """Events and schedule -> live features, results, pre-game features, issues, quarantine.

    Results come first, so a cold start already has labels for the pre-game table. Without an event
    table only the pre-game features are built.
    """
    plays = tables.read_if_there(spark, f"{root}/plays")
    if plays is not None:
        build_live(spark, root, plays)
    build_pregame(spark, root, recent)


def build_live(spark: SparkSession, root: str, plays: DataFrame) -> None:
    games = tables.read_table(spark, f"{root}/games", required=schemas.GAME_COLUMNS, name="games")
    features, results, issues = live.build_live(tables.load_plays(plays), games)
    good, bad = _sides(features, schemas.LIVE_NON_NULL, schemas.LIVE_COLUMNS)
    tables.overwrite(good, f"{root}/live_features", ["season"])
    tables.quarantine(bad, f"{root}/live_features_invalid")
    good, bad = _sides(results, schemas.RESULT_NON_NULL, schemas.RESULT_COLUMNS)
    tables.overwrite(good, f"{root}/game_results")
    tables.quarantine(bad, f"{root}/game_results_invalid")
    tables.quarantine(issues, f"{root}/live_issues")


def build_pregame(spark: SparkSession, root: str, recent: int = pregame.RECENT_GAMES) -> None:
    """Schedule and results, if there are any, -> pre-game features, one file range per date.

    Without results no game has a score: features rest on dates alone, labels stay open, and every
    game is listed in the issues.
    """
    games = tables.read_table(spark, f"{root}/games", required=schemas.GAME_COLUMNS, name="games")
    results = tables.read_optional(spark, f"{root}/game_results")
    rows = pregame.pregame_features(pregame.merge_results(pregame.final_games(games), results), recent)
    good, bad = _sides(rows, schemas.PREGAME_NON_NULL, schemas.PREGAME_COLUMNS)
    tables.write_sorted(good, f"{root}/pregame_features", ["game_date", "game_id"], ["season"])
    tables.quarantine(bad, f"{root}/pregame_features_invalid")
    stored = _features(spark, root, "pregame_features")
    tables.quarantine(pregame.pregame_issues(stored), f"{root}/pregame_issues")


TYPES = {"pregame_features": schemas.PREGAME_FEATURES, "live_features": schemas.LIVE_FEATURES}


def _features(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A feature or prediction table with declared types; a season read from folder names is text."""
    return tables.read_typed(spark, f"{root}/{name}", TYPES.get(name, "season string"), name)


def check_readiness(
    spark: SparkSession, root: str, train: Sequence[str], test: str, **limits
) -> DataFrame:
    pre, events = (_features(spark, root, n) for n in ("pregame_features", "live_features"))
    report = coverage.training_readiness(spark, pre, events, train, test, **limits)
    tables.overwrite(report, f"{root}/training_readiness")
    return tables.read_table(spark, f"{root}/training_readiness")


def train_models(
    spark: SparkSession, root: str, version: str, train: Sequence[str] = (), test: str | None = None,
    test_size: float = 0.2, fit_options: dict | None = None, **limits,
) -> None:
    """Train both models by seasons (behind the readiness gate) or by a chronological split."""
    if bool(train) != bool(test):
        raise ValueError("give both train and test seasons, or neither")
    if train and not coverage.allows_training(
        check_readiness(spark, root, train, test, **limits)
    ).first().allowed:
        raise ValueError("training data is not ready; see the training_readiness table")
    for kind in ("pregame", "live"):
        rows = _features(spark, root, f"{kind}_features")
        is_live = kind == "live"
        if train:
            sides = split.season_split(rows, train, test)
        else:
            sides = (split.game_split if is_live else split.chronological_split)(
                model.training_rows(rows), test_size=test_size
            )
        if is_live:
            split.check_split(*sides)
        manifest = model.live_manifest(rows) if is_live else model.pregame_manifest(rows)
        report = model.train_and_report(*sides, manifest, live=is_live, **(fit_options or {}))
        report.scorer.save(f"{root}/models/{kind}/{version}")
        outputs = {"metrics": report.metrics, "calibration": report.calibration,
                   "phases": report.phases}
        for name, table in outputs.items():
            if table is not None:
                stamped = table.withColumn("model_version", F.lit(version))
                tables.overwrite(stamped, f"{root}/reports/{kind}_{name}/{version}")


def predict_all(spark: SparkSession, root: str, version: str) -> None:
    """Score both feature tables and store the predictions."""
    for kind, predict in (("pregame", model.predict_pregame), ("live", model.predict_live)):
        scorer = model.Scorer.load(spark, f"{root}/models/{kind}/{version}")
        scored = predict(_features(spark, root, f"{kind}_features"), scorer)
        tables.overwrite(scored, f"{root}/{kind}_predictions", ["season"])
        stored = _features(spark, root, f"{kind}_predictions")
        quality.check_probabilities(stored, ["home_win_probability"])


def evaluate(spark: SparkSession, root: str, version: str) -> None:
    """Summary, buckets, team accuracy and momentum reports from the stored predictions."""
    picks, events = (_features(spark, root, f"{k}_predictions") for k in ("pregame", "live"))
    report = lambda name: tables.read_optional(spark, f"{root}/reports/{name}/{version}")
    manual = tables.manual_results_at(spark, f"{root}/manual_results")
    results = tables.read_optional(spark, f"{root}/game_results")
    counted = {"pregame_predictions_count": picks, "live_event_predictions_count": events}
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(n).alias("metric"), "value")
        for n, df in counted.items()
    ])
    summary = metrics.evaluation_summary(
        report("pregame_metrics"), report("live_metrics"), report("live_phases"),
        {
            "pregame_predictions_full_dataset": metrics.pregame_summary(picks),
            "live_predictions_event_level": metrics.live_summary(events),
            "live_predictions_final_event":
                metrics.final_event_summary(replay.final_events(events)),
        },
        counts, None if manual is None else reconcile.manual_summary(manual, results),
    )
    outputs = {
        "evaluation_summary": summary,
        "probability_buckets": metrics.probability_buckets(picks),
        "team_accuracy": metrics.team_accuracy(picks),
        "momentum_swings": replay.biggest_swings(events),
    }
    for name, table in outputs.items():
        tables.overwrite(table, f"{root}/reports/{name}")


def series_reports(spark: SparkSession, root: str, playoff_root: str, version: str) -> None:
    """Series pre-game picks, per-game reports with the prediction lock, and the projected path.

    ``root`` holds the regular season and the models, ``playoff_root`` the playoff tables with
    their live features built by ``build_features``.
    """
    games = tables.read_table(spark, f"{playoff_root}/games")
    overrides = tables.read_or_empty(spark, f"{playoff_root}/overrides", schemas.OVERRIDES)
    broken = [(r.rule, r.key) for r in quality.override_violations(overrides).limit(5).collect()]
    if broken:
        raise ValueError(f"schedule overrides break their rules: {broken}")
    overrides = quality.normalize_overrides(overrides)
    results = tables.read_table(spark, f"{playoff_root}/game_results")
    plays = tables.read_table(spark, f"{playoff_root}/plays")
    live_model = model.Scorer.load(spark, f"{root}/models/live/{version}")
    scored = model.predict_live(_features(spark, playoff_root, "live_features"), live_model)
    tables.overwrite(scored, f"{playoff_root}/live_predictions", ["season"])
    scored = _features(spark, playoff_root, "live_predictions")

    regular = pregame.merge_results(
        pregame.final_games(tables.read_table(spark, f"{root}/games")),
        tables.read_table(spark, f"{root}/game_results"),
    )
    past = pregame.merge_results(tables.completed_playoffs(games), results)
    targets = series.target_games(games, overrides)
    features = pregame.series_pregame_features(regular, past, targets, results)
    pre_model = model.Scorer.load(spark, f"{root}/models/pregame/{version}")
    picks = scale.cut_lineage(model.predict_pregame(features, pre_model))

    report = scale.cut_lineage(series.series_report(games, overrides, scored, plays, results))
    upcoming = series.upcoming_report(report, picks)
    before = tables.read_optional(spark, f"{playoff_root}/reports/series_upcoming")
    if before is not None:
        upcoming = reconcile.lock_predictions(upcoming, before)
    upcoming = scale.cut_lineage(upcoming)
    manual = tables.manual_results_at(spark, f"{playoff_root}/manual_results")
    if manual is None:
        manual = spark.createDataFrame([], schemas.MANUAL_RESULTS)
    path = series.series_path(upcoming, series.actual_results(results, upcoming, manual))
    outputs = {
        "series_games": report, "series_upcoming": upcoming, "series_path": path,
        "series_outcome": series.series_outcome(report, upcoming),
        "playoff_coverage": coverage.playoff_coverage(games, plays),
    }
    for name, table in outputs.items():
        tables.overwrite(table, f"{playoff_root}/reports/{name}")
    export = series.series_live_export(scored, games)
    tables.guarded_overwrite(export, f"{playoff_root}/reports/series_live", "series live export")


def coverage_reports(spark: SparkSession, root: str, seasons: Sequence[str], train: Sequence[str] = (),
                     test: str | None = None) -> None:
    """Coverage of all five tables per season, with a readiness row if a split is named."""
    names = {"games": "games", "play_by_play": "plays", "live_features": "live_features",
             "game_results": "game_results", "pregame_features": "pregame_features"}
    found = {k: tables.read_if_there(spark, f"{root}/{v}") for k, v in names.items()}
    games = found["games"]
    if games is not None and found["play_by_play"] is not None and "season" not in found["play_by_play"].columns:
        seasons_of = games.select("game_id", "season").dropDuplicates(["game_id"])
        found["play_by_play"] = scale.lookup_join(found["play_by_play"], seasons_of, ["game_id"])
    typed = {k: None if df is None else df.withColumn("season", F.col("season").cast("string"))
             for k, df in found.items()}
    report = coverage.coverage_report(spark, seasons, typed)
    if train and test:
        report = report.unionByName(coverage.readiness_row(report, train, test))
    tables.overwrite(report.select(*coverage.COVERAGE_COLUMNS), f"{root}/reports/coverage")
    stored = tables.read_table(spark, f"{root}/reports/coverage")
    tables.overwrite(coverage.missing_seasons(stored), f"{root}/reports/coverage_missing")


ASSETS = ["games", "plays", "game_results", "live_features", "pregame_features", "live_predictions",
          "pregame_predictions"]
DEPENDS = {"live_features": ["plays"], "game_results": ["plays"], "pregame_features": ["game_results"],
           "live_predictions": ["live_features"], "pregame_predictions": ["pregame_features"]}


def dataset_health(spark: SparkSession, root: str, changed: str = "generated_at") -> None:
    """Profile of the stored tables, counts per status and the most severe problems.

    A table tells when it changed by its column ``changed``, if it has one.
    """
    found = {n: tables.read_if_there(spark, f"{root}/{n}") for n in ASSETS}
    has = lambda n, c: c if found[n] is not None and c in found[n].columns else None
    profile = coverage.dataset_profile(
        spark, found, {n: has(n, "game_id") for n in ASSETS}, {n: has(n, changed) for n in ASSETS},
        required=["games", "plays", "live_features", "pregame_features"], depends_on=DEPENDS)
    tables.overwrite(profile, f"{root}/reports/dataset_profile")
    stored = tables.read_table(spark, f"{root}/reports/dataset_profile")
    tables.overwrite(coverage.status_counts(stored), f"{root}/reports/dataset_status_counts")
    tables.overwrite(coverage.top_issues(stored, ["asset"]), f"{root}/reports/dataset_issues")
    tables.overwrite(coverage.freshness_check(stored), f"{root}/reports/dataset_freshness")


def compare_versions(spark: SparkSession, root: str, old: str, new: str) -> None:
    """Metrics, phases and calibration of two trained versions side by side, from their reports."""
    report = lambda name, v: tables.read_optional(spark, f"{root}/reports/{name}/{v}")
    for kind in ("pregame", "live"):
        held = [r for r in (report(f"{kind}_metrics", v) for v in (old, new)) if r is not None]
        if held:
            both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), held)
            tables.overwrite(metrics.compare_versions(both, old, new), f"{root}/reports/{kind}_comparison")
        tables_of = [r for r in (report(f"{kind}_calibration", v) for v in (old, new)) if r is not None]
        if tables_of:
            stacked = reduce(DataFrame.unionByName, tables_of)
            tables.overwrite(stacked, f"{root}/reports/{kind}_calibration_comparison")
    phases = metrics.phase_comparison(spark, report("live_phases", old), report("live_phases", new))
    tables.overwrite(phases, f"{root}/reports/phase_comparison")
