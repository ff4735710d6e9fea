import random

from pyspark.sql import functions as F

from tidemark.operators import live, scale

PLAYS = (
    "game_id string, event_num double, event_msg_type string, event_msg_action_type string, "
    "period int, pctimestring string, scoreHome double, scoreAway double, home_team string, "
    "away_team string, season string, game_date string, _seq long"
)
GAMES = (
    "game_id string, season string, game_date string, home_team string, away_team string, "
    "home_team_id string, away_team_id string, _seq long"
)
G = "0022400001"


def play(n, kind, sub, period, clock, h, a, seq, game=G):
    return (game, n, kind, sub, period, clock, h, a, "Team A", "Team B", "2024-25", "2024-11-01", seq)


ROWS = [
    play(2.0, "period", "start", 1, "PT12M00.00S", 0.0, 0.0, 0),
    play(4.0, "Jump Ball", None, 1, "PT12M00.00S", None, None, 1),
    play(10.0, "Made Shot", "Jump Shot", 1, "PT11M38.00S", 2.0, 0.0, 2),
    play(12.0, "Missed Shot", None, 1, "PT11M00.00S", None, None, 3),
    play(20.0, "Made Shot", "3PT", 2, "PT10M00.00S", 2.0, 3.0, 4),
    play(30.0, "Free Throw", None, 4, "PT00M30.00S", 5.0, 3.0, 5),
    play(999.0, "Instant Replay", None, 2, "PT01M31.00S", 2.0, 0.0, 6),
    play(10.0, "Made Shot", "DUPLICATE", 1, "PT11M38.00S", 2.0, 0.0, 7),
    play(1.0, "Foul", None, 1, "garbage", None, None, 8, "0022499999"),
]


def build(spark, rows=ROWS, block_rows=4):
    plays = spark.createDataFrame(rows, PLAYS)
    games = spark.createDataFrame(
        [(G, "2024-25", "2024-11-01", "Home", "Away", "100", "200", 0)], GAMES
    )
    return live.build_live(plays, games, block_rows=block_rows)


def test_game_state_and_labels(spark):
    features, _, _ = build(spark)
    rows = {r.event_num: r for r in features.filter(F.col("game_id") == G).collect()}
    assert [(rows[n].home_score, rows[n].away_score) for n in (2, 4, 10, 12, 20, 30, 999)] == [
        (0, 0), (0, 0), (2, 0), (2, 0), (2, 3), (5, 3), (5, 3)]
    assert [rows[n].is_scoring_event for n in (2, 4, 10, 12, 20, 30, 999)] == [
        False, False, True, False, True, True, False]
    assert [rows[n].seconds_remaining_game for n in (2, 10, 12, 20, 30)] == [
        2880, 2858, 2820, 2040, 30]
    assert rows[2].event_type_label == "start_period"
    assert rows[4].event_type_label == "jump_ball"
    assert rows[999].event_type_label == "instant_replay"
    assert rows[10].event_msg_action_type == "DUPLICATE"
    assert rows[10].is_field_goal_attempt and not rows[10].is_foul
    assert rows[2].home_team == "Home" and rows[2].home_team_id == "100"
    assert {r.home_team_won for r in rows.values()} == {1}


def test_results_and_issues(spark):
    _, results, issues = build(spark)
    (r,) = results.collect()
    assert (r.game_id, r.home_score, r.away_score, r.winner) == (G, 5, 3, "Home")
    found = {(i.game_id, i.issue_type): i.row_count for i in issues.collect()}
    assert found == {
        ("", "duplicate_events"): 1,
        ("0022499999", "missing_from_games"): 1,
        ("0022499999", "missing_scores"): 1,
        ("0022499999", "invalid_pctimestring"): 1,
    }


def test_unknown_game_keeps_its_own_metadata(spark):
    features, _, _ = build(spark)
    (r,) = features.filter("game_id = '0022499999'").collect()
    assert r.home_team == "Team A" and r.home_team_id is None and r.home_team_won is None


def test_tie_counts_for_the_away_side(spark):
    rows = [play(1.0, "Made Shot", None, 1, "10:00", 2.0, 2.0, 0)]
    _, results, _ = build(spark, rows)
    assert results.collect()[0].winner == "Away"


def test_running_score_matches_a_plain_loop(spark):
    rng = random.Random(7)
    rows, expected, seq = [], {}, 0
    for g in range(6):
        game = f"00224{g:05d}"
        h = a = 0.0
        last = None
        for n in range(1, 120):
            if rng.random() < 0.2:
                continue
            rh = None if rng.random() < 0.4 else float(rng.randint(0, n))
            ra = None if rng.random() < 0.4 else float(rng.randint(0, n))
            h, a = max(h, rh or 0.0), max(a, ra or 0.0)
            expected[(game, n)] = (h, a, last is not None and h + a > last)
            last = h + a
            rows.append(play(float(n), "Foul", None, 1, "10:00", rh, ra, seq, game))
            seq += 1
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, PLAYS)
    for block_rows in (1, 7, 1000):
        got = live.running_scores(events, block_rows=block_rows).collect()
        assert {(r.game_id, int(r.event_num)): (r.home_score, r.away_score, r.is_scoring_event)
                for r in got} == expected


def test_dedupe_is_cut_before_the_shuffle(spark):
    plan = live.dedupe_events(spark.createDataFrame(ROWS, PLAYS))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_lookup_has_one_plan_at_every_size(spark):
    facts = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7 END AS k", "id AS v")
    dim = spark.range(5).selectExpr("id AS k", "id * 10 AS d")
    for how in ("left", "inner"):
        got = scale.lookup_join(facts, dim, ["k"], how)
        want = facts.join(dim, "k", how)
        key = lambda r: (r.v, r.k, r.d)
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
        assert got._jdf.queryExecution().analyzed().toString().count("Join") == 1


def test_positions_and_totals_in_one_order(spark):
    df = spark.range(1000).selectExpr("id % 13 AS g", "CAST(hash(id) AS long) AS o", "id % 5 AS v")
    rows = scale.with_position(df.select("o"), "o").collect()
    assert [r.position for r in sorted(rows, key=lambda r: r.o)] == list(range(1000))
    assert {r.total for r in rows} == {1000}
    got = scale.with_total_before(df, ["g"], "o", "v", "t").collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r.g, r.o)):
        assert r.t == seen.get(r.g, 0)
        seen[r.g] = seen.get(r.g, 0) + r.v


def test_previous_row_crosses_blocks(spark):
    df = spark.range(400).selectExpr("id % 3 AS k", "id AS n", "id * 2 AS v")
    got = scale.add_previous(df, ["k"], "n", {"p": "v"}, block_rows=5).collect()
    assert all(r.p == (None if r.n < 3 else (r.n - 3) * 2) for r in got) and len(got) == 400


def test_a_hot_game_of_sparse_numbers_is_cut_into_bounded_blocks(spark):
    df = spark.range(10_000).selectExpr(
        "'hot' AS game_id", "CASE WHEN id % 4 > 0 THEN CAST(id * 1000003 AS double) END AS event_num")
    sizes = scale.with_block(df, ["game_id"], "event_num", (), 256).groupBy("game_id", scale.BLOCK).count()
    assert sizes.agg(F.max("count")).first()[0] == 256 and sizes.count() <= 10_000 / 256 + 9
    plan = live.running_scores(spark.createDataFrame(ROWS, PLAYS))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    rows = [line for line in text.splitlines() if "Window" in line and scale.SLOT in line]
    assert rows and all(scale.BLOCK in line for line in rows)


def test_rows_without_a_game_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0, 0.2), (None, 2.0, 0.3), ("g", 1.0, 0.5)],
                               "game_id string, event_num double, v double")
    got = {(r.game_id, r.event_num): r.p for r in scale.add_previous(df, ["game_id"], "event_num", {"p": "v"}).collect()}
    assert got == {(None, 1.0): None, (None, 2.0): 0.2, ("g", 1.0): None}
