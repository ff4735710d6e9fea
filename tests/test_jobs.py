import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans import jobs
from tidemark.sources import tables

GAMES = schemas.GAMES + ", _seq long"
PLAYS = ("game_id string, event_num double, event_msg_type string, event_msg_action_type string, "
         "period int, pctimestring string, scoreHome double, scoreAway double, home_team string, "
         "away_team string, season string, game_date string, _seq long")


def league(spark, root, prefix, seasons, per_season, kind, rng, teams):
    games, plays = [], []
    for s, season in enumerate(seasons):
        for i in range(per_season):
            home, away = (teams[0], teams[1]) if kind == "playoffs" else rng.sample(teams, 2)
            gid = f"{prefix}{22 + s}004{i + 1:02d}" if kind == "playoffs" else f"{prefix}{22 + s}{i:05d}"
            day = f"{season[:4]}-{'06' if kind == 'playoffs' else '01'}-{1 + i % 28:02d}"
            games.append((gid, season, day, home, away, home, away, "final", kind, len(games)))
            h = a = 0.0
            for n in range(1, 9):
                h, a = h + rng.randint(0, 4) + (home < away), a + rng.randint(0, 4)
                h += n == 8 and h == a
                plays.append((gid, float(n), "Made Shot" if n % 2 else "Foul", None, 1 + n // 3,
                              "05:00", h, a, home, away, season, day, len(plays)))
    spark.createDataFrame(games, GAMES).write.parquet(f"{root}/games")
    spark.createDataFrame(plays, PLAYS).write.parquet(f"{root}/plays")


@pytest.fixture(scope="module")
def roots(spark, tmp_path_factory):
    rng = random.Random(4)
    root, playoffs = (str(tmp_path_factory.mktemp(n)) for n in ("regular", "playoffs"))
    teams = ["A", "B", "C", "D"]
    league(spark, root, "002", ["2022-23", "2023-24", "2024-25"], 20, "regular_season", rng, teams)
    league(spark, playoffs, "004", ["2024-25"], 5, "playoffs", rng, teams)
    jobs.build_features(spark, root)
    jobs.build_features(spark, playoffs)
    return root, playoffs


def test_the_whole_way(spark, roots):
    root, playoffs = roots
    read = lambda path: tables.read_table(spark, path)
    assert read(f"{root}/live_features").count() == 480
    assert read(f"{root}/pregame_features").count() == 60
    with pytest.raises(ValueError, match="not ready"):
        jobs.train_models(spark, root, "v1", ["2022-23", "2023-24"], "2024-25")
    with pytest.raises(ValueError, match="both"):
        jobs.train_models(spark, root, "v1", ["2022-23"])
    jobs.train_models(spark, root, "v1", ["2022-23", "2023-24"], "2024-25",
                      fit_options={"max_iter": 10}, min_games=10, min_live_rows=100)
    jobs.predict_all(spark, root, "v1")
    jobs.evaluate(spark, root, "v1")
    summary = read(f"{root}/reports/evaluation_summary")
    assert summary.filter("section = 'live_model_training' AND metric = 'test_games'").first().value == 20
    assert read(f"{root}/live_predictions").count() == 480
    assert read(f"{root}/reports/momentum_swings").count() == 50

    jobs.series_reports(spark, root, playoffs, "v1")
    games = read(f"{playoffs}/reports/series_games")
    assert games.count() == 7 and games.filter("final_result_available").count() == 5
    upcoming = read(f"{playoffs}/reports/series_upcoming").filter("pregame_prediction_available")
    assert upcoming.count() == 5
    assert read(f"{playoffs}/reports/series_live").count() == 40
    outcome = read(f"{playoffs}/reports/series_outcome").first()
    assert outcome.games_played == 5 and outcome.champion in ("A", "B")


def test_completed_predictions_stay_locked(spark, roots):
    root, playoffs = roots
    path = f"{playoffs}/reports/series_upcoming"
    before = {r.game_id: r.home_win_probability_pregame
              for r in tables.read_table(spark, path).collect() if r.game_id}
    changed = tables.read_table(spark, path).withColumn(
        "home_win_probability_pregame", F.lit(0.123))
    changed.write.mode("overwrite").parquet(f"{playoffs}/snapshot")
    tables.overwrite(tables.read_table(spark, f"{playoffs}/snapshot"), path)
    jobs.series_reports(spark, root, playoffs, "v1")
    after = {r.game_id: r.home_win_probability_pregame
             for r in tables.read_table(spark, path).collect() if r.game_id}
    assert before and set(after) == set(before) and set(after.values()) == {0.123}


def test_features_without_results_or_events(spark, tmp_path):
    root = str(tmp_path)
    rng = random.Random(5)
    league(spark, f"{root}/full", "002", ["2024-25"], 12, "regular_season", rng, ["A", "B", "C"])
    games = tables.read_table(spark, f"{root}/full/games")
    games.write.parquet(f"{root}/games")
    jobs.build_features(spark, root)
    rows = tables.read_table(spark, f"{root}/pregame_features").collect()
    assert len(rows) == 12 and all(r.home_team_won is None for r in rows)
    assert all(r.home_win_pct_before == 0.5 and r.home_points_for_avg_before is None for r in rows)
    assert sum(r.home_games_played_before + r.away_games_played_before for r in rows) > 0
    assert tables.read_table(spark, f"{root}/pregame_issues").count() == 12
    assert tables.read_if_there(spark, f"{root}/live_features") is None


def test_typed_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("SELECT 7L AS season, 3.0D AS period, 'x' AS p, true AS is_foul, 'more' AS extra").write.parquet(path)
    rows = tables.read_typed(spark, path, "season string, period int, p double, is_foul int")
    assert rows.dtypes == [("season", "string"), ("period", "int"), ("p", "double"), ("is_foul", "int"),
                           ("extra", "string")]
    assert tuple(rows.first()) == ("7", 3, None, 1, "more")
    with pytest.raises(ValueError, match="missing required columns"):
        tables.read_typed(spark, path, "season string, absent int")


def test_reports_of_tables_and_versions(spark, roots):
    root, _ = roots
    options = {"fit_options": {"max_iter": 5}}
    jobs.train_models(spark, root, "a", **options)
    jobs.train_models(spark, root, "b", ["2022-23", "2023-24"], "2024-25", min_games=10, min_live_rows=100, **options)
    jobs.compare_versions(spark, root, "a", "b")
    read = lambda name: tables.read_table(spark, f"{root}/reports/{name}")
    rows = {r.metric: r for r in read("live_comparison").collect()}
    both = [tables.read_table(spark, f"{root}/reports/live_metrics/{v}").first().accuracy for v in "ab"]
    assert (rows["accuracy"].single_season_value, rows["accuracy"].multiseason_value) == tuple(both)
    assert {r.model_version for r in read("pregame_calibration_comparison").collect()} == {"a", "b"}
    assert read("phase_comparison").filter("metric = 'accuracy'").count() >= 1
    jobs.compare_versions(spark, root, "a", "absent")
    assert read("phase_comparison").first().interpretation.endswith("multi-season phase report missing.")

    jobs.coverage_reports(spark, root, ["2022-23", "1999-00"], ["2022-23"], "1999-00")
    found = {(r.section, r.season): r for r in read("coverage").collect()}
    assert len(found) == 11 and found["live_features", "2022-23"].available_rows == 160
    assert found["readiness", "train=2022-23;test=1999-00"].status == "fail"
    assert [r.season for r in read("coverage_missing").collect()] == ["1999-00"]
    jobs.dataset_health(spark, root)
    status = {r.asset: (r.status, r.row_count) for r in read("dataset_profile").collect()}
    assert status["live_features"] == ("ok", 480) and len(status) == len(jobs.ASSETS)
    assert read("dataset_freshness").first().status == "pass"


def test_manual_results_of_the_old_layout(spark, tmp_path):
    path = str(tmp_path / "manual_results")
    assert tables.manual_results_at(spark, path) is None
    old = spark.createDataFrame([("0042400401", 100, 90, "A", "manual", "2025-06-05")],
                                "game_id string, home_score int, away_score int, winner string, source string, confirmed_at string")
    old.write.parquet(path)
    assert tables.manual_results_at(spark, path).first().notes in (None, "")
    old.drop("winner").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="winner"):
        tables.manual_results_at(spark, path)
