import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import coverage, quality, series

GAMES = ("game_id string, season string, season_type string, game_date string, home_team string, "
         "away_team string, status string, home_team_id string, away_team_id string")


def game(gid, day, home="A", away="B", season="2022-23", kind="Playoffs", status="final"):
    return (gid, season, kind, day, home, away, status, "1", "2")


FINALS = [game(f"004220040{i}", f"2023-06-0{i}") for i in (1, 2, 3, 4)]
OTHER = [game("0042200311", "2023-05-20", "A", "C")]


def numbers(spark, rows):
    found = series.final_series_games(spark.createDataFrame(rows, GAMES)).collect()
    return {r.game_id: r.finals_game_number for r in found}


def test_round_code_decides(spark):
    got = numbers(spark, FINALS[::-1] + OTHER)
    assert got == {f"004220040{i}": i for i in (1, 2, 3, 4)}


def test_no_guess_when_ids_can_be_read(spark):
    assert numbers(spark, OTHER * 5) == {}


def test_pair_fallback_prefers_more_meetings_then_recency(spark):
    rows = [game(f"x{i}", f"2023-05-{10 + i}", "A", "B") for i in range(4)]
    rows += [game(f"y{i}", f"2023-05-{12 + i}", "C", "D") for i in range(4)]
    rows += [game(f"z{i}", f"2023-06-{12 + i}", "E", "F") for i in range(3)]
    assert numbers(spark, rows) == {f"y{i}": i + 1 for i in range(4)}
    assert set(numbers(spark, rows[-3:])) == {"z0", "z1", "z2"}
    assert numbers(spark, rows[:1]) == {}


def test_seven_games_at_most(spark):
    rows = [game(f"x{i}", f"2023-05-{10 + i}") for i in range(9)]
    assert sorted(numbers(spark, rows).values()) == [1, 2, 3, 4, 5, 6, 7]


def test_playoff_filter(spark):
    rows = spark.createDataFrame(
        FINALS[:1] + [game("1", "d", kind="Regular Season"), game("2", "d", kind="postseason")], GAMES)
    assert {r.game_id for r in series.playoff_games(rows).collect()} == {FINALS[0][0], "2"}
    typed = rows.drop("season_type").withColumn("game_type", F.lit("regular"))
    assert series.playoff_games(typed).isEmpty()
    assert series.playoff_games(rows.drop("season_type")).count() == 3


def test_labels_leave_other_games_alone(spark):
    rows = {r.game_id: r for r in series.number_games(
        spark.createDataFrame(FINALS + OTHER, GAMES)).collect()}
    assert rows["0042200311"].playoff_round == "" and rows["0042200311"].finals_game_number is None
    assert rows["0042200402"].playoff_round == series.FINAL_ROUND_LABEL


def override(n, status="scheduled", date="2023-06-10", gid="", source="manual_schedule", notes=""):
    return ("2022-23", n, gid, date, "B", "A", "2", "1", status, "Playoffs", source, notes)


def merged(spark, *overrides):
    planned = spark.createDataFrame(list(overrides), schemas.OVERRIDES)
    games = spark.createDataFrame(FINALS, GAMES)
    return games, quality.normalize_overrides(planned)


def test_collected_game_wins_and_ids_are_made_up(spark):
    games, planned = merged(spark, override(4, gid="zzz"), override(5),
                            override(6, "if_necessary", date=None), override(9))
    rows = {r.finals_game_number: r for r in series.merge_schedule(games, planned).collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6}
    assert rows[4].game_id == "0042200404" and rows[4].schedule_source is None
    assert rows[5].game_id == "finals_schedule_202223_g5" and rows[6].game_id == ""
    assert {r.finals_game_number for r in series.target_games(games, planned).collect()} == {1, 2, 3, 4, 5}


def test_dense_report(spark):
    games, planned = merged(spark, override(5), override(6, "if_necessary", date=None))
    predictions = spark.createDataFrame(
        [("0042200401", 1.0, 0.6, "A"), ("0042200401", 9.0, 0.2, "B"), ("0042200402", 1.0, 0.6, "A")],
        "game_id string, event_num double, home_win_probability double, predicted_winner string")
    plays = spark.createDataFrame([("0042200401", 1.0), ("0042200403", 1.0)],
                                  "game_id string, event_num double")
    results = spark.createDataFrame([("0042200401", "B"), ("0042200402", " ")],
                                    "game_id string, winner string")
    report = series.series_report(games, planned, predictions, plays, results)
    rows = {r.finals_game_number: r for r in report.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7] and report.columns == schemas.SERIES_REPORT_COLUMNS
    one = rows[1]
    assert (one.home_win_probability_start, one.home_win_probability_final) == (0.6, 0.2)
    assert (one.start_prediction_correct_if_final, one.final_prediction_correct_if_final) == (False, True)
    assert one.replay_available and one.final_result_available and one.notes == ""
    assert not rows[2].final_result_available and rows[2].notes == series.NOTE_NO_REPLAY
    assert rows[3].notes == series.NOTE_NO_PREDICTION
    assert rows[5].game_status == "scheduled" and rows[5].notes == series.NOTE_MANUAL_SCHEDULE
    assert rows[6].notes == series.NOTE_IF_NECESSARY
    assert rows[7].game_status == "not_available_yet" and rows[7].game_id == ""
    pregame = spark.createDataFrame(
        [("0042200401", 0.6, 0.4, "A", False), ("finals_schedule_202223_g5", 0.3, 0.7, "A", None)],
        "game_id string, home_win_probability double, away_win_probability double, "
        "predicted_winner string, prediction_correct boolean")
    up = {r.finals_game_number: r for r in series.upcoming_report(report, pregame).collect()}
    assert up[1].pregame_prediction_correct_if_final is False and up[1].prediction_confidence == 0.6
    assert up[5].pregame_prediction_correct_if_final is None and up[5].prediction_confidence == 0.7
    assert up[3].notes == series.NOTE_NO_PREDICTION and up[4].notes == series.NOTE_PREGAME_FAILED
    nxt = series.next_upcoming(series.upcoming_report(report, pregame)).collect()
    assert [r.finals_game_number for r in nxt] == [5]
    shown = {r.finals_game_number: r for r in series.overview(
        report, series.upcoming_report(report, pregame)).collect()}
    assert shown[1].status == "Completed" and shown[7].matchup == "TBD" and shown[7].winner == "—"
    won = series.series_outcome(report, series.upcoming_report(report, pregame)).first()
    assert (won.champion, won.champion_wins, won.runner_up, won.final_leans_correct) == ("B", 1, "—", 1)


# ---- projected path ------------------------------------------------------------------------------
UPCOMING = ("season string, game_id string, finals_game_number int, game_date string, "
            "home_team string, away_team string, game_status string, "
            "pregame_prediction_available boolean, predicted_winner_pregame string")
OPEN = ["scheduled", "if_necessary", "if_necessary_scheduled", "not_available_yet"]


def fold(games, actual):
    """Walk one series game by game."""
    out, a, b, over = [], 0, 0, False
    for n, status, available, pick, gid in games:
        winner, source = actual.get(gid, (None, "none"))
        before, used = (a, b), None
        needed = not over and not (n == 7 and (a, b) != (3, 3))
        if over:
            kind = "not_needed_under_projection"
        elif winner:
            used = winner
            kind = "actual_manual_override" if source == "manual_override" else "actual_official"
        elif not needed:
            kind = "if_necessary_pending"
        elif status not in OPEN:
            kind = "not_available"
        elif available and pick:
            used = pick
            kind = ("conditional_model_projected" if status == "if_necessary_scheduled"
                    else "model_projected")
        else:
            kind = "needed_but_prediction_unavailable"
        a, b = a + (used == "A"), b + (used == "B")
        over = over or max(a, b) >= 4
        out.append((n, kind, used, *before, a, b, needed, over))
    return out


def test_path_equals_the_fold(spark):
    rng = random.Random(11)
    rows, actual, want = [], [], {}
    for s in range(300):
        games, known = [], {}
        for n in range(1, 8):
            gid = f"{s}-{n}"
            status = rng.choice([*OPEN, "completed", "odd"])
            pick, available = rng.choice(["A", "B", "A", "B", None, "C"]), rng.random() < 0.8
            if rng.random() < 0.45:
                known[gid] = (rng.choice("AB"), rng.choice(["official/local", "manual_override"]))
                actual.append((gid, *known[gid]))
            games.append((n, status, available, pick, gid))
            rows.append((f"s{s}", gid, n, "d", "A", "B", status, available, pick))
        want[f"s{s}"] = fold(games, known)
    results = spark.createDataFrame(actual, "game_id string, winner string, source string")
    path = series.series_path(spark.createDataFrame(rows, UPCOMING), results)
    got = {}
    for r in path.orderBy("season", "finals_game_number").collect():
        got.setdefault(r.season, []).append((
            r.finals_game_number, r.projection_type, r.projected_winner_used, r.team_a_wins_before,
            r.team_b_wins_before, r.team_a_wins_after, r.team_b_wins_after,
            r.game_needed_under_projection, r.series_over_after_game))
    assert got == want
    kinds = {k for games in want.values() for _, k, *_ in games}
    assert len(kinds) == 8


def path_of(spark, winners, picks, manual=()):
    rows = [("s", str(n), n, "d", "Knicks", "Spurs",
             "completed" if n <= len(winners) else "scheduled", n > len(winners), picks.get(n))
            for n in range(1, 8)]
    official = spark.createDataFrame(
        [(str(i + 1), w) for i, w in enumerate(winners)] or [("x", "")], "game_id string, winner string")
    up = spark.createDataFrame(rows, UPCOMING).withColumns(
        {"final_result_available": F.lit(False), "final_winner": F.lit(None).cast("string")})
    fixes = spark.createDataFrame(list(manual) or [("x", "")], "game_id string, winner string")
    return series.series_path(up, series.actual_results(official, up, fixes))


def test_state_with_manual_correction(spark):
    path = path_of(spark, ["Knicks", "Spurs", "Knicks"], {4: "Knicks", 5: "Knicks"},
                   [("2", "Knicks")])
    state = series.series_state(path).first()
    assert state.actual_score_text == "Knicks 3 – 0 Spurs" and state.actual_leader == "Knicks"
    assert state.projected_score_text == "Knicks 4 – 0 Spurs" and state.last_actual_game == 3
    assert state.next_projected_game is None
    shown = {r.finals_game_number: r for r in series.path_display(path).collect()}
    assert shown[2].path_type == "Actual (manual correction)" and shown[4].score_after == "4–0"


def test_game_seven_needs_three_all(spark):
    level = path_of(spark, ["Knicks", "Spurs"] * 3, {7: "Spurs"}).collect()[6]
    assert level.projection_type == "model_projected" and level.team_b_wins_after == 4
    short = path_of(spark, ["Knicks", "Spurs"] * 2, {7: "Spurs"}).collect()[6]
    assert short.projection_type == "if_necessary_pending" and short.notes == series.NOTE_GAME_7


# ---- coverage ---------------------------------------------------------------------------------
def season_rows(spark, **counts):
    rows = [(f"{s}{i}", s.replace("_", "-")) for s, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows or [("x", "x")], "game_id string, season string")


@pytest.mark.parametrize("have, status", [(96, "pass"), (95, "pass"), (50, "warning"), (0, "fail")])
def test_coverage_ratio(spark, have, status):
    report = coverage.coverage_report(
        spark, ["s"], {"games": season_rows(spark, s=100), "play_by_play": season_rows(spark, s=have)})
    rows = {r.section: r for r in report.collect()}
    assert rows["play_by_play"].status == status and rows["games"].status == "warning"
    ready = coverage.readiness_row(report, ["s"], "s2").first()
    assert ready.status == "fail" and "s2: incomplete" in ready.notes


def test_coverage_without_expectation(spark):
    report = coverage.coverage_report(
        spark, ["s", "t"], {"games": season_rows(spark, s=1200), "play_by_play": season_rows(spark, t=3),
                            "live_features": None})
    rows = {(r.section, r.season): r for r in report.collect()}
    assert rows[("games", "s")].status == "pass"
    assert rows[("play_by_play", "t")].status == "fail" and rows[("play_by_play", "t")].coverage_pct == 100.0
    assert rows[("live_features", "s")].status == "fail"
    assert not coverage.coverage_allows_training(report).first().allowed


def test_null_season_is_its_own_group(spark):
    df = spark.createDataFrame([("1", None), ("1", None), ("2", "s")], "game_id string, season string")
    got = {r.season: (r.row_count, r.game_count) for r in coverage.season_counts(df).collect()}
    assert got == {None: (2, 1), "s": (1, 1)}


def test_training_readiness(spark):
    rows = [(f"{s}{i}", s, 1 if i else None) for s in ("a", "b", "t") for i in range(100)]
    pre = spark.createDataFrame(rows, "game_id string, season string, home_team_won int")
    full = pre.fillna({"home_team_won": 0})
    checks = coverage.training_readiness(spark, full, full, ["a", "b"], "t", min_live_rows=100)
    assert coverage.allows_training(checks).first().allowed
    checks = coverage.training_readiness(spark, pre, None, ["a", "b"], "z")
    bad = {r.check for r in checks.filter("status = 'fail'").collect()}
    assert {"pregame_features_season_z", "pregame_features_min_games_z", "live_features_exists",
            "pregame_features_target_train_a"} <= bad
    assert not coverage.allows_training(checks).first().allowed
    assert coverage.allows_training(checks, ["split"]).first().allowed
    assert not coverage.allows_training(checks, ["none"]).first().allowed
    with pytest.raises(ValueError):
        coverage.training_readiness(spark, pre, pre, ["a"], "a")


def test_playoff_coverage_previews_missing_games(spark):
    games = spark.createDataFrame(FINALS + [game(f"x{i}", "d") for i in range(7)], GAMES)
    plays = spark.createDataFrame([(g[0],) for g in FINALS] + [(None,)], "game_id string")
    r = coverage.playoff_coverage(games, plays).first()
    assert (r.playoff_games, r.games_with_pbp, r.finals_games_detected) == (11, 4, 4)
    assert r.notes == "missing: x0, x1, x2, x3, x4..." and r.pbp_coverage_pct == 36.4


def test_profile_and_rollups(spark):
    t = lambda day, n=1: spark.createDataFrame(
        [(str(i), day) for i in range(n)], "game_id string, at string").withColumn(
        "at", F.col("at").cast("timestamp"))
    profile = coverage.dataset_profile(
        spark, {"a": t("2024-01-01"), "b": t("2024-02-01", 2), "c": None, "d": None,
                "e": t("2024-01-01").filter("false")},
        dict.fromkeys("abcde", "game_id"), dict.fromkeys("abcde", "at"),
        required=["c"], depends_on={"a": ["b"], "b": ["a"]})
    got = {r.asset: r.status for r in profile.collect()}
    assert got == {"a": "stale", "b": "ok", "c": "missing", "d": "not_required", "e": "warning"}
    assert coverage.overall_status(profile).first().overall_status == "missing"
    assert [r.asset for r in coverage.top_issues(profile, ["asset"], 2).collect()] == ["c", "a"]
    counts = {r.status: r.n for r in coverage.status_counts(profile).collect()}
    assert counts == {"missing": 1, "stale": 1, "warning": 1, "unknown": 0, "ok": 1, "not_required": 1}
    assert coverage.freshness_check(profile).first().status == "fail"
    fine = coverage.overall_status(profile.filter("asset IN ('b', 'd')")).first()
    assert fine.overall_status == "ok"


def test_export_check(spark):
    report = spark.createDataFrame([("0042500401", True), ("0042500402", True), ("0042500403", False)],
                                   "game_id string, replay_available boolean")
    export = spark.createDataFrame([("42500401",)], "game_id string")
    assert [r.game_id for r in coverage.export_gaps(export, report).collect()] == ["0042500402"]
    assert coverage.export_check(export, report).first().status == "warning"
    assert coverage.export_check(export.filter("false"), report).first().status == "fail"
    both = export.union(spark.createDataFrame([("42500402",)], "game_id string"))
    assert coverage.export_check(both, report).first().status == "pass"
