from pyspark.sql import functions as F

from tidemark.functions import exprs as X


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def one(spark, items, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(items)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


def test_clock(spark):
    got = one(spark, ["PT11M38.00S", "PT45.00S", "PT", " 10:50 ", "10:50.5", "PT5M", "garbage",
                      "", "nan", None, "1:2:3"], X.clock_seconds)
    assert got == [698.0, 45.0, 0.0, 650.0, 650.5, 300.0, None, None, None, None, None]
    bad = one(spark, ["garbage", "", None, "10:50"], X.clock_unparsed)
    assert bad == [True, False, False, False]


def test_game_seconds(spark):
    got = values(spark, [(1, 720.0), (4, 0.0), (4, 30.0), (5, 300.0), (5, 0.0), (6, 0.0),
                         (None, 1.0), (1, None)], "p int, s double", X.game_seconds_left("p", "s"))
    assert [g[0] for g in got] == [2880.0, 0.0, 30.0, 0.0, -300.0, -600.0, None, None]


def test_clock_display(spark):
    got = one(spark, ["PT04M20.00S", "pt1h02m03.9s", "4:20", "", None, "later", "PT"],
              X.clock_display)
    assert got == ["4:20", "62:03", "4:20", "—", "—", "later", "0:00"]


def test_phase(spark):
    got = one(spark, [2161.0, 2160.0, 721.0, 720.0, -5.0, None], X.game_phase, "double")
    assert got == ["early_game", "mid_game", "mid_game", "late_game", "late_game", "unknown"]


def test_event_label(spark):
    rows = [("Made Shot", None), (" FREE THROW ", None), ("period", "end"), ("period", " Start "),
            ("period", None), ("4", None), ("13", None), ("99", None), ("4.0", None),
            ("Coach", None), (None, None)]
    got = values(spark, rows, "k string, s string", X.event_label("k", "s"))
    assert [g[0] for g in got] == [
        "made_shot", "free_throw", "end_period", "start_period", "start_period", "rebound",
        "end_period", "unknown", "rebound", "unknown", "unknown"]


def test_scores_and_winner(spark):
    rows = [("3", "0"), ("", "0"), ("nan", "1"), (None, "1"), ("x", "1")]
    got = values(spark, rows, "h string, a string", X.score_text("h", "a"),
                 X.score_margin_text("h", "a"))
    assert got == [("3 - 0", "3"), ("", ""), ("", ""), ("", ""), ("x - 1", "")]
    rows = [(2.0, 1.0), (1.0, 2.0), (1.0, 1.0), (None, 1.0)]
    got = values(spark, rows, "h double, a double", X.winner_side("h", "a"),
                 X.home_won_or_null("h", "a"), X.home_won_tie_is_away("h", "a"))
    assert got == [("home", 1, 1), ("away", 0, 0), ("tie", None, 0), (None, None, None)]


def test_matchup_and_pair(spark):
    assert one(spark, ["BOS vs. MIA", "MIA @ BOS", "a vs. b @ c", "BOS MIA", None],
               X.matchup_side) == ["home", "away", "home", None, None]
    assert values(spark, [("b", "a")], "h string, a string", X.team_pair("h", "a"))[0][0] == ["a", "b"]


def test_seasons(spark):
    got = one(spark, ["2024-25", "1999-00", "2024-26", "24-25", None], X.season_is_valid)
    assert got == [True, True, False, False, False]
    assert one(spark, [" 2023-24, ,2024-25"], X.season_list) == [["2023-24", "2024-25"]]


def test_ids(spark):
    assert one(spark, ["42500401", "0042500401", "12345678901", None], X.pad_id) == [
        "0042500401", "0042500401", "12345678901", None]
    assert one(spark, ["0042200401", "0042200311", "0022200401", "42200401", None],
               X.playoff_round) == ["004", "003", None, None, None]


def test_season_types(spark):
    items = ["Playoffs", " playoff ", "regular_season", "postseason", "weird", None]
    assert one(spark, items, X.season_type_strict) == [
        "Playoffs", "Playoffs", "Regular Season", None, None, None]
    assert one(spark, items, X.season_type_lenient) == [
        "Playoffs", "Playoffs", "Regular Season", "Playoffs", "Regular Season", "Regular Season"]


def test_status_and_labels(spark):
    rows = [("Final", "d"), ("not started", "d"), ("if necessary", None), (None, None), ("odd", "d"),
            ("odd", None)]
    got = values(spark, rows, "s string, d string", X.game_status("s", "d"))
    assert [g[0] for g in got] == ["completed", "scheduled", "if_necessary", "not_available_yet",
                                   "odd", "not_available_yet"]
    assert one(spark, ["model_projected", "brand_new"], X.projection_label) == [
        "Model projection", "Brand New"]
    assert one(spark, ["if_necessary_scheduled", "postponed"], X.status_label) == [
        "If necessary, scheduled", "Postponed"]


def test_blank_and_matchup_text(spark):
    assert one(spark, ["", " ", "nan", "None", None, "x"], X.is_blank) == [True] * 5 + [False]
    rows = [("H", "A"), ("", None), ("H", "")]
    got = values(spark, rows, "h string, a string", X.matchup_text("h", "a"))
    assert [g[0] for g in got] == ["A @ H", "TBD", "TBD @ H"]


def test_coverage_pct_and_polarity(spark):
    rows = [(96, 100), (5, 0), (0, 0)]
    assert [g[0] for g in values(spark, rows, "a long, b long", X.coverage_pct("a", "b"))] == [
        96.0, 100.0, 0.0]
    rows = [("accuracy", 0.1), ("log_loss", 0.1), ("accuracy", 0.0), ("true_positive", 1.0),
            ("accuracy", None), ("n", 1.0)]
    got = [g[0] for g in values(spark, rows, "m string, d double", X.polarity_text("m", "d"))]
    assert got[0].startswith("Multi-season value is higher (higher")
    assert got[1].startswith("Multi-season value is higher (lower")
    assert got[2].startswith("Values are equal") and got[3].startswith("Confusion")
    assert got[4] == "" and got[5].startswith("Compare with caution")


def test_flags(spark):
    df = spark.createDataFrame([("foul",), ("missed_shot",)], "l string")
    rows = df.select(*[c.alias(n) for n, c in X.event_flags(F.col("l")).items()]).collect()
    assert rows[0].is_foul and not rows[0].is_field_goal_attempt and rows[1].is_field_goal_attempt
