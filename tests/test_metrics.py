import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, replay, split

JUDGED = "model_version string, y int, p double, yhat int, seconds_remaining_game double"


def judged(spark, rows):
    full = [(v, y, p, int(p > 0.5), s) for v, y, p, s in rows]
    return spark.createDataFrame(full, JUDGED)


def brute_auc(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    if not pos or not neg:
        return None
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_equals_pair_counting(spark):
    rng = random.Random(5)
    rows = [(v, rng.randint(0, 1), rng.choice([round(rng.random(), 2), rng.random()]), 0.0)
            for v in ("a", "b") for _ in range(400)]
    rows += [("one", 1, 0.3, 0.0), ("one", 1, 0.7, 0.0)]
    got = {r.model_version: r.roc_auc
           for r in metrics.roc_auc(judged(spark, rows), ["model_version"]).collect()}
    for v in ("a", "b", "one"):
        want = brute_auc([(y, p) for m, y, p, _ in rows if m == v])
        assert got[v] is None if want is None else got[v] == pytest.approx(want, abs=1e-12)


def test_metrics_row(spark):
    rows = [("v", 1, 0.9, 0.0), ("v", 0, 0.2, 0.0), ("v", 1, 0.4, 0.0), ("v", 0, 1.0, 0.0)]
    (r,) = metrics.classifier_metrics(judged(spark, rows)).collect()
    assert (r.true_positive, r.true_negative, r.false_positive, r.false_negative) == (1, 1, 1, 1)
    assert r.accuracy == 0.5 and r.brier_score == pytest.approx((0.01 + 0.04 + 0.36 + 1.0) / 4)
    want = -(math.log(0.9) + math.log(0.8) + math.log(0.4) + math.log(metrics.EPSILON)) / 4
    assert r.log_loss == pytest.approx(want)


def test_two_bucket_rules_differ_on_the_edges(spark):
    ps = [0.0, 0.1, 0.3, 0.5, 0.6, 0.7, 1.0]
    right = metrics.calibration(judged(spark, [("v", 1, p, 0.0) for p in ps]))
    got = {r.probability_bucket: r.row_count for r in right.collect()}
    assert got == {"0.0-0.1": 2, "0.2-0.3": 1, "0.4-0.5": 1, "0.5-0.6": 1, "0.6-0.7": 1, "0.9-1.0": 1}
    picks = spark.createDataFrame([(p, 1) for p in ps] + [(0.5, None)],
                                  "home_win_probability double, actual_home_team_won int")
    got = {r.probability_bucket: r.row_count for r in metrics.probability_buckets(picks).collect()}
    assert got == {"0.0-0.1": 1, "0.1-0.2": 1, "0.3-0.4": 1, "0.5-0.6": 1, "0.6-0.7": 1,
                   "0.7-0.8": 1, "0.9-1.0": 1}


def test_phases(spark):
    rows = [("v", 1, 0.9, 2500.0), ("v", 1, 0.8, 2500.0), ("v", 0, 0.2, 1000.0),
            ("v", 1, 0.9, 1000.0), ("v", 0, 0.4, -5.0), ("v", 1, 0.4, None)]
    got = {r.phase: r for r in metrics.phase_metrics(judged(spark, rows)).collect()}
    assert set(got) == {"early_game", "mid_game", "late_game", "unknown"}
    assert got["early_game"].log_loss is None and got["mid_game"].log_loss is not None
    assert got["unknown"].accuracy == 0.0


PICKS = ("game_id string, game_date string, home_team string, away_team string, "
         "home_win_probability double, away_win_probability double, predicted_label int, "
         "actual_home_team_won int, prediction_correct boolean")


def picks(spark):
    return spark.createDataFrame([
        ("1", "d1", "A", "B", 0.80, 0.20, 1, 1, True), ("2", "d2", "B", "A", 0.51, 0.49, 1, 0, False),
        ("3", "d3", "A", "C", 0.30, 0.70, 0, 1, False), ("4", "d4", "C", "B", 0.20, 0.80, 0, None, None),
    ], PICKS)


def test_pregame_summary(spark):
    got = {r.metric: r.value if r.text is None else r.text
           for r in metrics.pregame_summary(picks(spark)).collect()}
    assert got["total_predictions"] == 4 and got["labeled_predictions"] == 3
    assert got["prediction_accuracy"] == pytest.approx(1 / 3)
    assert got["most_confident_prediction"] == "d1 | A vs B"
    assert got["closest_prediction_to_50_50"] == "d2 | B vs A" and got["closest_home_probability"] == 0.51
    none = {r.metric for r in metrics.pregame_summary(picks(spark).filter("game_id = '4'")).collect()}
    assert "prediction_accuracy" not in none and "total_predictions" in none


def test_team_accuracy_and_labels(spark):
    got = {r.team: (r.games_as_home, r.games_as_away, r.total_games, r.accuracy)
           for r in metrics.team_accuracy(picks(spark)).collect()}
    assert got == {"A": (2, 1, 3, pytest.approx(1 / 3)), "B": (1, 1, 2, 0.5), "C": (0, 1, 1, 0.0)}
    assert metrics.accuracy_if_labelled(picks(spark)).first().accuracy == pytest.approx(1 / 3)


def test_compare_versions_with_one_absent(spark):
    rows = metrics.classifier_metrics(
        judged(spark, [("old", 1, 0.9, 0.0), ("old", 0, 0.2, 0.0)]), ["model_version"])
    got = metrics.compare_versions(rows, "old", "new").collect()
    assert len(got) == 8 and all(r.multiseason_value is None and r.difference is None for r in got)
    assert all(r.interpretation == metrics.SETUP_NOTE for r in got)


# ---- replay --------------------------------------------------------------------------------
LIVE = ("game_id string, event_num long, seconds_remaining_game double, "
        "home_win_probability double, predicted_winner string")


def live_rows(spark):
    return spark.createDataFrame([
        ("1", 1, 2880.0, 0.55, "H"), ("1", 2, 2800.0, 0.60, "H"), ("1", 9, 100.0, 0.80, "H"),
        ("2", 4, 2880.0, 0.50, "A"), ("2", 5, 2000.0, 0.20, "A"), ("2", None, 0.0, 0.9, "H"),
    ], LIVE)


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_replay_columns(spark, block_rows):
    rows = replay.add_replay_columns(live_rows(spark).filter("game_id = '1'"), block_rows)
    got = [(r.game_elapsed_seconds, round(r.probability_change, 9))
           for r in rows.orderBy("event_num").collect()]
    assert got == [(0.0, 0.0), (80.0, 0.05), (2780.0, 0.2)]


@pytest.mark.parametrize("block_rows", [1, 1000])
def test_swings(spark, block_rows):
    rows = live_rows(spark).filter("event_num IS NOT NULL")
    top = replay.biggest_swings(rows, 2, block_rows).collect()
    assert [(r.game_id, r.event_num) for r in top] == [("2", 5), ("1", 9)]
    per_game = replay.top_swings_per_game(rows, 1, block_rows).collect()
    assert {(r.game_id, r.event_num) for r in per_game} == {("2", 5), ("1", 9)}
    assert replay.top_swings_per_game(rows, 10, block_rows).count() == 5


def test_final_events_skip_missing_numbers_and_keep_the_first_tie(spark):
    rows = live_rows(spark).withColumn("_seq", F.monotonically_increasing_id())
    tie = rows.filter("event_num = 9").withColumns(
        {"_seq": F.lit(10**12), "home_win_probability": F.lit(0.1)})
    got = {r.game_id: r.home_win_probability
           for r in replay.final_events(rows.unionByName(tie), "_seq").collect()}
    assert got == {"1": 0.80, "2": 0.20}


def test_catalog_and_long_views(spark):
    rows = picks(spark).withColumns({"season": F.lit("2024-25"), "event_num": F.lit(1)})
    catalog = replay.games_catalog(rows)
    assert replay.filter_catalog(catalog, "2024-25", "C").count() == 2
    assert replay.filter_catalog(catalog, "All seasons", "All teams").count() == 4
    assert replay.filter_catalog(catalog, "2023-24").count() == 0
    kept = replay.in_catalog(rows, replay.filter_catalog(catalog, None, "C"))
    assert {r.game_id for r in kept.collect()} == {"3", "4"}
    assert {r.team for r in replay.team_names(rows).collect()} == {"A", "B", "C"}
    wide = spark.createDataFrame([("1", "A", "B", 0.5, None, 3.0, 2.0)],
                                 "game_id string, home_team string, away_team string, "
                                 "home_win_pct_before double, away_win_pct_before double, "
                                 "home_rest_days double, away_rest_days double")
    got = {(r.metric, r.team): r.value for r in replay.team_comparison(wide).collect()}
    assert got == {("Win %", "A"): 0.5, ("Rest days", "A"): 3.0, ("Rest days", "B"): 2.0}
    assert {r.label for r in replay.feature_sections(wide).collect()} == {
        "Home win %", "Home rest days", "Away rest days"}


# ---- splits ---------------------------------------------------------------------------------
def test_chronological_split(spark):
    days = [(f"{i:02d}", f"2024-01-{i:02d}") for i in range(1, 11)]
    train, test = split.chronological_split(
        spark.createDataFrame(days, "game_id string, game_date string"), test_size=0.25)
    assert sorted(r.game_id for r in test.collect()) == ["09", "10"]  # 2.5 rounds to even
    assert train.count() == 8
    train, test = split.chronological_split(
        spark.createDataFrame(days[:2], "game_id string, game_date string"), test_size=0.01)
    assert (train.count(), test.count()) == (1, 1)
    train, test = split.chronological_split(
        spark.createDataFrame(days[:1], "game_id string, game_date string"))
    assert (train.count(), test.count()) == (1, 0)
    with pytest.raises(ValueError):
        split.chronological_split(train, test_size=1.0)


def test_undated_games_go_to_the_end(spark):
    rows = [("a", "2024-01-01"), ("b", None), ("c", "2024-01-02"), ("d", "2024-01-03")]
    _, test = split.chronological_split(
        spark.createDataFrame(rows, "game_id string, game_date string"), test_size=0.25)
    assert [r.game_id for r in test.collect()] == ["b"]


def test_whole_games_stay_together(spark):
    rows = [(f"g{g}", n, f"2024-01-0{g}") for g in range(1, 7) for n in range(8)]
    df = spark.createDataFrame(rows, "game_id string, event_num int, game_date string")
    train, test = split.game_split(df, 0.3)
    assert {r.game_id for r in test.collect()} == {"g5", "g6"} and train.count() == 32
    split.check_split(train, test)
    with pytest.raises(ValueError, match="g1"):
        split.check_split(df, df)


def test_season_split(spark):
    df = spark.createDataFrame([("2023-24",), ("2024-25",), ("2025-26",)], "season string")
    train, test = split.season_split(df, ["2023-24", "2024-25"], "2025-26")
    assert (train.count(), test.count()) == (2, 1)
    with pytest.raises(ValueError, match="2023-24"):
        split.season_split(df, ["2023-24"], "2023-24")
