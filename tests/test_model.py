import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import model


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        x, z = rng.gauss(0, 1), rng.gauss(5, 3)
        kind = rng.choice(["a", "b", None])
        y = int(x + 0.2 * z + (kind == "a") + rng.gauss(0, 1) > 1.5)
        rows.append((f"{i:04d}", f"2024-01-{1 + i % 28:02d}", "H", "A", x, None if i % 10 == 0 else z,
                     kind, None if i % 50 == 0 else y))
    return spark.createDataFrame(rows, "game_id string, game_date string, home_team string, "
                                 "away_team string, x double, z double, kind string, home_team_won int")


MANIFEST = model.Manifest(["x", "z"], ["kind"])


@pytest.fixture(scope="module")
def scorer(table):
    return model.fit(table, MANIFEST, median_error=0.0)


def newton(features, y, c=1.0, steps=50):
    """Ridge logistic regression with a free intercept."""
    x = np.hstack([features, np.ones((len(y), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) / c
    ridge[-1, -1] = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (p - y) + ridge @ w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, gradient)
    return 1 / (1 + np.exp(-x @ w))


def test_probabilities_match_a_direct_solve(table, scorer):
    rows = model.score(model.training_rows(table), scorer).toPandas()
    z = rows["z"].fillna(rows["z"].sort_values().iloc[rows["z"].count() // 2 - 1])
    cols = []
    for v in (rows["x"], z):
        cols.append((v - v.mean()) / v.std(ddof=1))
    kind = rows["kind"].fillna(scorer.manifest.modes["kind"])
    cols += [(kind == k).astype(float) for k in ("a", "b")]
    want = newton(np.column_stack(cols), rows["home_team_won"].to_numpy(float))
    assert np.abs(want - rows["home_win_probability"].to_numpy()).max() < 0.01


def test_unseen_and_missing_categories_are_scored(spark, scorer):
    df = spark.createDataFrame([(0.0, 1.0, "zzz"), (0.0, None, None)], "x double, z double, kind string")
    assert model.score(df, scorer).filter("home_win_probability IS NULL").isEmpty()


def test_saved_model_scores_the_same(spark, table, scorer, tmp_path):
    scorer.save(str(tmp_path / "m"))
    again = model.Scorer.load(spark, str(tmp_path / "m"))
    key = lambda s: [r.home_win_probability for r in model.score(table, s).orderBy("game_id").collect()]
    assert key(scorer) == key(again) and again.manifest == scorer.manifest


def test_prediction_columns(spark):
    df = spark.createDataFrame([(0.5, "H", "A", 1), (0.49, "H", "A", 1), (0.9, "H", "A", None)],
                               "home_win_probability double, home_team string, away_team string, "
                               "home_team_won int")
    rows = model.prediction_columns(df).collect()
    assert [r.predicted_label for r in rows] == [1, 0, 1]
    assert [r.predicted_winner for r in rows] == ["H", "A", "H"]
    assert [r.prediction_correct for r in rows] == [True, False, None]
    assert all(abs(r.home_win_probability + r.away_win_probability - 1) < 1e-12 for r in rows)


def test_guards(spark, table, scorer):
    with pytest.raises(ValueError, match="missing required columns"):
        model.score(table.drop("x"), scorer)
    leaky = model.Scorer(model.Manifest(["winner"]), scorer.model)
    with pytest.raises(ValueError, match="leakage"):
        model.score(table.withColumn("winner", F.lit(1.0)), leaky)
    with pytest.raises(ValueError, match="two labelled rows"):
        model.fit(table.limit(1), MANIFEST)
    with pytest.raises(ValueError, match="all_features"):
        model.Manifest.of({})
    assert model.Manifest.of(["a"]).all == ["a"]
    got = model.Manifest.of({"all_features": ["a", "b"], "categorical_features": ["b"]})
    assert (got.numeric, got.categorical) == (["a"], ["b"])


def test_event_kind_columns_follow_their_type(spark):
    worded = spark.createDataFrame([], "period int, event_msg_type string, event_type_label string")
    coded = spark.createDataFrame([], "period int, event_msg_type int, event_type_label string")
    assert model.live_manifest(worded).categorical == ["event_msg_type", "event_type_label"]
    assert model.live_manifest(coded).numeric == ["period", "event_msg_type"]
    pre = model.pregame_manifest(spark.createDataFrame([], "home_rest_days double, winner string"))
    assert pre.all == ["home_rest_days"]
    assert not set(schemas.LIVE_NUMERIC) & set(schemas.LIVE_FORBIDDEN)


def test_report(table):
    train, test = table.filter("game_id < '0200'"), table.filter("game_id >= '0200'")
    report = model.train_and_report(train, test, MANIFEST, live=False)
    row = report.metrics.first()
    assert row.n_train == 196 and row.n_test == 98 and row.n_features == 3
    assert 0.6 < row.accuracy <= 1 and 0.5 < row.roc_auc <= 1
    assert report.calibration.agg(F.sum("row_count")).first()[0] == 98
    with pytest.raises(ValueError, match="two games"):
        one = table.limit(20).withColumn("game_id", F.lit("g"))
        model.train_and_report(one, one, MANIFEST, live=True)


def test_a_column_without_values_is_left_out(spark, table):
    df = table.withColumn("blank", F.lit(None).cast("double"))
    assert model.fit(df, model.Manifest(["x", "blank"])).manifest.numeric == ["x"]


def test_moments_equal_a_direct_count(spark, table):
    rows = model.training_rows(table)
    n, found = model.moments(rows.withColumn("none", F.lit(None).cast("double")), ["x", "z", "none"], 0.0)
    frame = rows.toPandas()
    assert n == len(frame) and set(found) == {"x", "z"}
    for c in found:
        filled = frame[c].fillna(frame[c].median())
        assert found[c].median == pytest.approx(frame[c].median())
        assert found[c].mean == pytest.approx(filled.mean()) and found[c].deviation == pytest.approx(filled.std(ddof=1))


def test_sketched_median_keeps_its_rank_error(spark):
    df = spark.range(200_000, numPartitions=8).select(F.pow(F.rand(3), F.lit(4.0)).alias("v")).cache()
    for error in (0.02, 1e-3):
        median = model.moments(df, ["v"], error)[1]["v"].median
        assert abs(df.filter(F.col("v") <= median).count() / 200_000 - 0.5) <= error


def test_categories_of_different_sizes(spark, table):
    df = table.withColumn("day", F.substring("game_date", 9, 2))
    scorer = model.fit(df, model.Manifest(["x"], ["kind", "day"]))
    assert set(scorer.manifest.modes) == {"kind", "day"}
    assert model.score(df, scorer).filter("home_win_probability IS NULL").isEmpty()


def test_the_fit_reads_its_rows_three_times_at_most(spark, table, tmp_path):
    """Once for numbers, once for categories, once for the vectors that the optimiser keeps."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    rows = model.training_rows(table).cache()
    n = rows.count()
    model.fit(rows.withColumn("x", counted("x")), model.Manifest(["x", "z"], ["kind"]))
    assert n <= seen.value <= 2 * n  # the category pass needs no numbers
    constant = model.fit(rows.withColumn("x", F.lit(2.0)), MANIFEST)
    assert model.score(rows, constant).filter("home_win_probability IS NULL").isEmpty()
