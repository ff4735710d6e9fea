import datetime as dt
import random

from tidemark.operators import pregame

GAMES = (
    "game_id string, season string, game_date string, home_team string, away_team string, "
    "home_team_id string, away_team_id string, status string, game_type string, "
    "home_score double, away_score double"
)


def game(gid, date, home, away, h, a, season="2024-25"):
    return (gid, season, date, f"Team {home}", f"Team {away}", home, away, "final",
            "regular_season", h, a)


THREE = [
    game("0022400001", "2024-11-01", "100", "200", 110.0, 100.0),
    game("0022400002", "2024-11-04", "200", "100", 120.0, 90.0),
    game("0022400003", "2024-11-07", "100", "200", 101.0, 99.0),
]


def features(spark, rows):
    out = pregame.pregame_features(spark.createDataFrame(rows, GAMES)).collect()
    return {r.game_id: r for r in out}


def test_third_game_sees_two_prior_games(spark):
    r = features(spark, THREE)["0022400003"]
    assert r.home_games_played_before == r.away_games_played_before == 2
    assert (r.home_wins_before, r.home_losses_before, r.home_win_pct_before) == (1, 1, 0.5)
    assert (r.home_points_for_avg_before, r.home_points_allowed_avg_before) == (100.0, 110.0)
    assert r.home_rest_days == r.away_rest_days == 3.0
    assert r.home_team_won == 1


def test_first_game_gets_neutral_values(spark):
    r = features(spark, THREE)["0022400001"]
    assert (r.home_games_played_before, r.home_wins_before, r.home_win_pct_before) == (0, 0, 0.5)
    assert r.home_points_for_avg_before is None and r.home_rest_days == 3.0
    assert r.points_for_avg_diff_before is None and r.rest_days_diff == 0.0


def test_same_day_other_season_and_null_dates_are_not_history(spark):
    rows = THREE + [
        game("0022400004", "2024-11-07", "100", "200", 90.0, 80.0),
        game("0022300009", "2024-01-01", "100", "200", 90.0, 80.0, season="2023-24"),
        game("0022400005", None, "100", "200", 90.0, 80.0),
    ]
    got = features(spark, rows)
    assert got["0022400004"].home_games_played_before == 2
    assert got["0022300009"].home_games_played_before == 0
    assert got["0022400005"].home_games_played_before == 0


def test_unknown_outcomes_stay_unknown(spark):
    rows = [game("1", "2024-11-01", "100", "200", None, None),
            game("2", "2024-11-03", "100", "200", None, None)]
    r = features(spark, rows)["2"]
    assert r.home_games_played_before == 1 and r.home_wins_before is None
    assert r.home_win_pct_before == 0.5 and r.home_recent_win_pct_before == 0.5
    assert r.home_team_won is None


def brute(rows, team, date, season, n=5):
    prior = sorted(
        (r[2], r[0], (None if r[9] is None or r[9] == r[10] else float((r[9] > r[10]) == (r[5] == team))),
         r[9] if r[5] == team else r[10])
        for r in rows if team in (r[5], r[6]) and r[1] == season and r[2] < date)
    known = [p[2] for p in prior if p[2] is not None]
    recent = [p[2] for p in prior[-n:] if p[2] is not None]
    points = [p[3] for p in prior if p[3] is not None]
    rest = (dt.date.fromisoformat(date) - dt.date.fromisoformat(prior[-1][0])).days if prior else 3
    return (len(prior), round(sum(known) / len(known), 9) if known else 0.5,
            round(sum(recent) / len(recent), 9) if recent else 0.5, float(rest),
            round(sum(points) / len(points), 9) if points else None)


def test_matches_a_full_scan_on_random_seasons(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        home, away = rng.sample(["1", "2", "3", "4", "5"], 2)
        day = dt.date(2024, 10, 1) + dt.timedelta(days=rng.randint(0, 60))
        score = (None, None) if rng.random() < 0.3 else (float(rng.randint(80, 99)), float(rng.randint(80, 99)))
        rows.append(game(f"{i:010d}", day.isoformat(), home, away, *score,
                         season=rng.choice(["2023-24", "2024-25"])))
    got = features(spark, rows)
    for r in rows:
        f = got[r[0]]
        assert brute(rows, r[5], r[2], r[1]) == (
            f.home_games_played_before, round(f.home_win_pct_before, 9),
            round(f.home_recent_win_pct_before, 9), f.home_rest_days,
            None if f.home_points_for_avg_before is None else round(f.home_points_for_avg_before, 9))


def test_merge_results_keeps_the_last_row(spark):
    games = spark.createDataFrame(THREE, GAMES)
    results = spark.createDataFrame(
        [("0022400001", 1.0, 2.0, 1), ("0022400001", 7.0, 2.0, 2)],
        "game_id string, home_score double, away_score double, _seq long")
    got = {r.game_id: r.home_score for r in pregame.merge_results(games, results).collect()}
    assert got == {"0022400001": 7.0, "0022400002": None, "0022400003": None}
    assert pregame.merge_results(games, results.select("game_id")) is games


def test_series_targets_never_count_as_history(spark):
    regular = spark.createDataFrame(THREE, GAMES)
    playoffs = spark.createDataFrame(
        [game("0042400401", "2025-06-01", "100", "200", 100.0, 90.0),
         game("0042400402", "2025-06-03", "100", "200", 100.0, 90.0)], GAMES)
    targets = playoffs.drop("home_score", "away_score")
    results = spark.createDataFrame(
        [("0042400401", 100.0, 90.0)], "game_id string, home_score double, away_score double")
    rows = {r.game_id: r for r in pregame.series_pregame_features(
        regular, playoffs, targets, results).collect()}
    assert set(rows) == {"0042400401", "0042400402"}
    assert rows["0042400401"].home_games_played_before == 3
    assert rows["0042400402"].home_games_played_before == 4
    assert rows["0042400401"].home_team_won == 1 and rows["0042400402"].home_team_won is None
