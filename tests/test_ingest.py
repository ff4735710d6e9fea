import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import ingest, quality, reconcile
from tidemark.sources import tables

TEAM_ROWS = ("season string, season_type string, GAME_ID string, TEAM_ID long, TEAM_NAME string, "
             "GAME_DATE string, MATCHUP string, _seq long")


def team_rows(spark, *rows):
    full = [("2024-25", "Regular Season", g, t, n, "2024-11-01", m, i)
            for i, (g, t, n, m) in enumerate(rows)]
    return spark.createDataFrame(full, TEAM_ROWS)


def pair(spark, *rows):
    clean = ingest.clean_team_rows(team_rows(spark, *rows))
    groups = ingest.game_groups(clean)
    return clean, groups


HOME = ("1", 1610612738, "Boston Celtics", "BOS vs. MIA")
AWAY = ("1", 1610612748, "Miami Heat", "MIA @ BOS")


def test_complete_game(spark):
    clean, groups = pair(spark, HOME, AWAY)
    (g,) = ingest.pair_games(groups).collect()
    assert (g.home_team, g.away_team, g.home_team_id, g.status, g.game_type) == (
        "Boston Celtics", "Miami Heat", "1610612738", "final", "regular_season")


@pytest.mark.parametrize("rows, reason", [
    ([HOME], "missing_away_row"),
    ([AWAY], "missing_home_row"),
    ([("1", 1, "X", "BOS MIA"), HOME], "invalid_matchup_format;missing_away_row"),
    ([HOME, HOME, AWAY], "multiple_home_rows"),
    ([("1", 1, None, "BOS vs. MIA"), AWAY], "missing_required_fields"),
])
def test_skip_reasons(spark, rows, reason):
    clean, groups = pair(spark, *rows)
    assert ingest.pair_games(groups).isEmpty()
    (s,) = ingest.skipped_games(clean, groups).collect()
    assert s.reason_skipped == reason and s.raw_row_count == len(rows)
    assert len(s.matchup_values.split(" | ")) == len(rows)


def test_big_skipped_game_is_listed_in_parts(spark):
    clean, groups = pair(spark, *[HOME] * 2500)
    parts = ingest.skipped_games(clean, groups, part_rows=100).collect()
    assert sorted(p.part for p in parts) == list(range(25))
    assert all(p.home_row_count == 2500 and p.reason_skipped for p in parts)
    assert sum(len(p.team_names.split(" | ")) for p in parts) == 2500
    assert ingest.skipped_rows(clean, groups).count() == 2500


def test_missing_feed_column_fails_early(spark):
    with pytest.raises(ValueError, match="MATCHUP"):
        ingest.clean_team_rows(team_rows(spark, HOME).drop("MATCHUP"))


RAW = ("gameId string, actionNumber int, clock string, period int, location string, "
       "description string, actionType string, subType string, scoreHome string, scoreAway string")


def test_description_routing_scores_and_metadata(spark):
    raw = spark.createDataFrame([
        ("1", 2, "PT12M00.00S", 1, "", "tip", "period", "start", "0", "0"),
        ("1", 21, "PT10M50.00S", 1, "v", "three", "Made Shot", "Jump Shot", "0", "3"),
        ("1", 23, "PT10M35.00S", 1, "h", "answer", "Made Shot", "Pullup", "3", "3"),
        ("1", 5, "PT11M45.00S", 1, "h", "miss", "Missed Shot", "", "", ""),
        ("1", 6, "PT11M40.00S", 1, "z", "odd", "Foul", "", "1", "x"),
    ], RAW)
    games = spark.createDataFrame([("1", "H", "A", "2024-25", "2024-11-01")],
                                  "game_id string, home_team string, away_team string, "
                                  "season string, game_date string")
    rows = {int(r.event_num): r for r in ingest.normalize_plays(raw, games).collect()}
    assert rows[2].neutral_description == "tip" and rows[2].home_description == ""
    assert rows[21].visitor_description == "three" and rows[21].score_margin == "-3"
    assert rows[23].home_description == "answer" and rows[23].score == "3 - 3"
    assert rows[5].score == "" and rows[5].score_margin == ""
    assert rows[6].home_description == rows[6].visitor_description == rows[6].neutral_description == ""
    assert rows[6].score == "1 - x" and rows[6].score_margin == ""
    assert {r.home_team for r in rows.values()} == {"H"}


def test_games_to_collect(spark):
    games = spark.createDataFrame([(str(i), "s", "d") for i in range(6)],
                                  "game_id string, season string, game_date string")
    done = spark.createDataFrame([("0",), ("1",), (None,)], "game_id string")
    ids = lambda df: sorted(r.game_id for r in df.collect())
    assert ids(ingest.games_to_collect(games, done, limit=2)) == ["2", "3"]
    assert ids(ingest.games_to_collect(games, done, limit=0)) == ["2", "3", "4", "5"]
    assert ids(ingest.games_to_collect(games, done, game_id="1")) == []
    assert ids(ingest.games_to_collect(games, None, game_id="1")) == ["1"]


def test_merge_failures(spark):
    schema = "game_id string, reason_failed string, _seq long"
    old = spark.createDataFrame([("1", "api_error", 0), ("2", "api_error", 1), ("3", "x", 2)], schema)
    new = spark.createDataFrame([("2", "empty_response", 3), ("4", "a", 4), ("4", "b", 5)], schema)
    good = spark.createDataFrame([("1",)], "game_id string")
    got = {r.game_id: r.reason_failed for r in ingest.merge_failures(old, new, good).collect()}
    assert got == {"2": "empty_response", "3": "x", "4": "b"}
    assert ingest.merge_failures(None, new, good).count() == 2


def test_team_stats(spark):
    raw = spark.createDataFrame(
        [(1610612738, "Boston", 82, 110.5, 3.0, "2024-25", "playoffs")],
        "TEAM_ID long, TEAM_NAME string, GP int, PTS double, OFF_RATING double, season string, "
        "season_type string")
    (r,) = ingest.normalize_team_stats(raw).collect()
    assert (r.team_id, r.season_type, r.points, r.off_rating) == ("1610612738", "Playoffs", 110.5, 3.0)
    assert "pace" not in ingest.normalize_team_stats(raw).columns
    with pytest.raises(ValueError, match="GP"):
        ingest.normalize_team_stats(raw.drop("GP"))


# ---- quality -------------------------------------------------------------------------------
def test_split_valid_and_contracts(spark):
    df = spark.createDataFrame([("1", 1), (None, 2), ("3", None)], "a string, b int")
    good, bad = quality.split_valid(df, ["a"])
    assert good.count() == 2 and bad.count() == 1
    with pytest.raises(ValueError, match="missing required columns"):
        quality.split_valid(df, ["a"], ["zz"])
    rows = {(r.dataset, r.check): r.status for r in quality.contract_rows(
        spark, {"t": df, "gone": None, "opt": None, "empty": df.filter("false")},
        {"t": ["a", "zz"]}, optional=["opt"]).collect()}
    assert rows[("t", "columns")] == "fail" and rows[("gone", "exists")] == "fail"
    assert rows[("opt", "exists")] == "not_applicable" and rows[("empty", "has_rows")] == "warning"


def test_probabilities_and_leakage(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (None,), (-0.1,)], "p double")
    (r,) = quality.probability_violations(df, ["p"]).collect()
    assert r.offending_rows == 3 and "1.5" in r.shown and "null" in r.shown
    with pytest.raises(ValueError, match="1.5"):
        quality.check_probabilities(df, ["p"])
    quality.check_probabilities(df.filter("p = 0.5"), ["p"])
    with pytest.raises(ValueError, match="winner"):
        quality.check_no_leakage(["period", "winner"], schemas.LIVE_FORBIDDEN)
    quality.check_no_leakage(["home_score"], schemas.LIVE_FORBIDDEN)


def test_override_rules(spark):
    row = ("2025-26", 4, "", "2026-06-10", "H", "A", "1", "2", "scheduled", "Playoffs",
           "manual_schedule", "")
    bad = ("2025-26", 5, "", None, "H", "A", " ", "2", " If_Necessary_Scheduled ", "Playoffs", "x", "")
    df = spark.createDataFrame([row, row, bad], schemas.OVERRIDES)
    found = sorted((r.rule, r.detail) for r in quality.override_violations(df).collect())
    assert found == [("duplicate_key", "2"), ("invalid_source", "x"),
                     ("missing_required", "game_date"), ("missing_required", "home_team_id")]
    wide = df.withColumn("winner", F.lit("H")).drop("notes")
    shape = {(r.rule, r.detail) for r in quality.override_violations(wide).collect()}
    assert shape == {("forbidden_column", "winner"), ("missing_column", "notes")}


# ---- reconciliation -----------------------------------------------------------------------
def corrections(spark, *rows):
    return spark.createDataFrame(
        rows, "game_id string, home_score double, away_score double, source string, "
        "confirmed_at string, notes string, _seq long")


def test_corrections(spark):
    games = spark.createDataFrame([(str(i), "H", "A") for i in range(1, 9)],
                                  "game_id string, home_team string, away_team string")
    existing = spark.createDataFrame([("2", 1, 0, "H", "api", "t0")],
                                     "game_id string, home_score int, away_score int, "
                                     "winner string, source string, confirmed_at string")
    batch = corrections(
        spark, ("1", 117.0, 116.0, " Manual ", "t", " ok ", 0), ("2", 90.0, 99.0, "api", "t", None, 1),
        ("3", 5.0, 5.0, "api", "t", None, 2), ("4", -1.0, 5.0, "api", "t", None, 3),
        ("5", 1.5, 5.0, "api", "t", None, 4), ("6", 1.0, 5.0, "fax", "t", None, 5),
        ("99", 1.0, 5.0, "api", "t", None, 6), ("1", 100.0, 90.0, "api", "t", None, 7))
    good, bad = reconcile.check_corrections(batch, games, existing)
    (r,) = good.collect()
    assert (r.game_id, r.home_score, r.winner, r.source, r.notes) == ("1", 117, "H", "manual", "ok")
    assert {(b.game_id, b.reject_reason) for b in bad.collect()} == {
        ("2", "already_exists"), ("3", "tie_not_allowed"), ("4", "negative_score"),
        ("5", "scores_not_integers"), ("6", "invalid_source"), ("99", "unknown_game"),
        ("1", "duplicate_in_batch")}
    good, _ = reconcile.check_corrections(batch, games, existing, allow_overwrite=True)
    merged = {m.game_id: m for m in reconcile.apply_corrections(existing, good).collect()}
    assert merged["2"].winner == "A" and merged["1"].home_score == 100
    assert reconcile.apply_corrections(existing, good).columns == schemas.MANUAL_COLUMNS


def test_comparison_statuses(spark):
    schema = "game_id string, home_score double, away_score double, winner string"
    manual = spark.createDataFrame([("1", 117.0, 116.0, "H"), ("2", 1.0, 0.0, "H"),
                                    ("3", 1.0, 0.0, " "), ("4", 1.0, 0.0, "X"), ("5", 1.0, 0.0, "H")],
                                   schema)
    official = spark.createDataFrame([("1", 117.0, 116.0, "H"), ("2", 2.0, 0.0, "H"),
                                      ("3", 1.0, 0.0, "H"), ("4", 1.0, 0.0, "H"), ("6", 1.0, 0.0, "H")],
                                     schema)
    got = {r.game_id: r.comparison_status
           for r in reconcile.compare_results(manual, official).collect()}
    assert got == {"1": "match", "2": "mismatch", "3": "match", "4": "mismatch",
                   "5": "no_official_result_available", "6": "no_manual_result_available"}


def test_prediction_lock(spark):
    schema = "game_id string, game_status string, predicted_winner string, win_prob double, " \
             "final_prediction_note string"
    now = spark.createDataFrame([
        ("0042500401", "completed", "new", 0.9, "n"), ("0042500402", "scheduled", "new", 0.9, "n"),
        ("0042500403", "Final", "new", 0.9, "n"), ("0042500404", "completed", "new", 0.9, "n")], schema)
    old = spark.createDataFrame([
        ("42500401", "scheduled", "old", 0.1, "o"), ("42500402", "scheduled", "old", 0.1, "o"),
        ("42500403", "scheduled", " ", None, "o")], schema)
    got = {r.game_id[-1]: (r.predicted_winner, r.win_prob, r.final_prediction_note)
           for r in reconcile.lock_predictions(
               now, old, columns=["predicted_winner", "win_prob", "absent"]).collect()}
    assert got == {"1": ("old", 0.1, "n"), "2": ("new", 0.9, "n"), "3": ("new", 0.9, "n"),
                   "4": ("new", 0.9, "n")}


# ---- stored tables --------------------------------------------------------------------------
@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_upsert_touches_only_its_partitions(spark, folder):
    import os

    schema = "game_id string, event_num int, v string, _seq long, season string"
    make = lambda *rows: spark.createDataFrame(rows, schema)
    path = f"{folder}/t"
    tables.upsert(path, make(("1", 1, "a", 0, "s1"), ("1", 1, "b", 1, "s1"), ("2", 1, "c", 2, "s2"),
                             ("9", 1, "n", 2, None)), ["game_id", "event_num"], ["season"])
    untouched = sorted(os.listdir(f"{path}/season=s2"))
    tables.upsert(path, make(("1", 1, "z", 0, "s1"), ("1", 2, "y", 0, "s1"), ("8", 1, "m", 0, None)),
                  ["game_id", "event_num"], ["season"])
    got = {(r.game_id, r.event_num): r.v
           for r in tables.read_table(spark, path, make().schema).collect()}
    assert got == {("1", 1): "z", ("1", 2): "y", ("2", 1): "c", ("9", 1): "n", ("8", 1): "m"}
    assert sorted(os.listdir(f"{path}/season=s2")) == untouched


def test_optional_guarded_and_fallback(spark, folder):
    df = spark.createDataFrame([("1",)], "a string")
    assert tables.read_optional(spark, f"{folder}/none") is None
    tables.overwrite(df, f"{folder}/x")
    with pytest.raises(ValueError, match="left as it is"):
        tables.guarded_overwrite(df.filter("false"), f"{folder}/x")
    assert tables.read_table(spark, f"{folder}/x").count() == 1
    tables.overwrite(df.filter("false"), f"{folder}/e")
    assert tables.read_optional(spark, f"{folder}/e") is None
    assert tables.primary_or_fallback(None, df) == (df, True)
    assert tables.primary_or_fallback(df, None) == (df, False)
    assert tables.read_or_empty(spark, f"{folder}/none", "a string").isEmpty()


def test_logs_and_legacy_notes(spark, folder):
    log = spark.createDataFrame([("pbp", "a", 1), ("pbp", "b", 3), ("games", "c", 2)],
                                "endpoint string, state string, logged_at long")
    tables.append_log(log.filter("logged_at < 3"), f"{folder}/log")
    tables.append_log(log.filter("logged_at = 3"), f"{folder}/log")
    got = {r.endpoint: r.state for r in tables.latest_attempts(
        tables.read_table(spark, f"{folder}/log")).collect()}
    assert got == {"pbp": "b", "games": "c"}
    legacy = spark.createDataFrame([], schemas.MANUAL_RESULTS).drop("notes")
    assert tables.load_manual_results(legacy).columns[-1] == "notes"


def test_csv_reader_keeps_ids_and_bad_lines(spark, folder):
    with open(f"{folder}/g.csv", "w") as out:
        out.write("game_id,event_num\n0022400001,3\n0022400002,x\n")
    rows = tables.read_csv(spark, f"{folder}/g.csv", "game_id string, event_num int",
                           ["game_id"]).collect()
    assert rows[0].game_id == "0022400001" and rows[0]._corrupt_record is None
    assert rows[1].event_num is None and rows[1]._corrupt_record == "0022400002,x"


def test_landing_jobs(spark, folder):
    rows = team_rows(spark, HOME, AWAY, ("2", 5, "Lone", "LON vs. ONE"))
    paths = [f"{folder}/{n}" for n in ("games", "skipped", "invalid")]
    tables.land_schedule(rows, *paths)
    tables.land_schedule(rows, *paths)
    assert tables.read_table(spark, paths[0]).count() == 1
    assert tables.read_table(spark, paths[1]).count() == 1
    assert tables.read_if_there(spark, paths[2]) is None
    with pytest.raises(ValueError, match="no valid rows"):
        tables.land_schedule(rows.filter("GAME_ID = '2'"), f"{folder}/g2", f"{folder}/s2", f"{folder}/i2")
    with pytest.raises(ValueError, match="no valid rows"):
        tables.land_playoffs(rows, f"{folder}/g3", f"{folder}/s3", f"{folder}/i3")


def test_land_team_stats(spark, folder):
    cols = ", ".join(f"{c} {'string' if c == 'TEAM_NAME' else 'double'}"
                     for c in schemas.TEAM_STATS_BASE)
    row = [f"t{i}" if c == "TEAM_NAME" else float(i) for i, c in enumerate(schemas.TEAM_STATS_BASE)]
    raw = spark.createDataFrame(
        [(*row, "2024-25", "Regular Season", 0), (*row, "2024-25", "preseason", 1)],
        f"{cols}, season string, season_type string, _seq long")
    tables.land_team_stats(raw, f"{folder}/stats", f"{folder}/bad")
    assert tables.read_table(spark, f"{folder}/stats").count() == 1
    assert tables.read_table(spark, f"{folder}/bad").count() == 1
