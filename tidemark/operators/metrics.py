"""Classifier quality, calibration, and summaries of scored games and events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import scale

EPSILON = 2.220446049250313e-16  # float64 machine epsilon, the log-loss clip
CORE_METRICS = ["accuracy", "roc_auc", "log_loss", "brier_score"]
PHASE_METRICS = ["accuracy", "log_loss", "brier_score"]
BUCKET_EDGES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
LABEL = "actual_home_team_won"
SETUP_NOTE = (  # fixed value
    "Evaluation setups differ — single-season uses within-season chronological split; "
    "multi-season uses future-season holdout (closer to deployment)."
)
TEST_NOTE = "Chronological hold-out test set from model training."  # fixed values
REFERENCE_NOTE = (
    "Full-dataset reference metric for dashboard use — "
    "not the same as chronological test-set performance."
)
EVENT_NOTE = "Event-weighted — rows within a game are correlated."


# ---- classifier metrics ------------------------------------------------------------------
def _log_loss(y: Column, p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))
    return F.avg(-F.log(F.when(y == 1, clipped).otherwise(1 - clipped)))


def roc_auc(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """Exact AUC per group: ties count half, null when a group has one class only.

    Rows are first summed per distinct score; the running count of negatives below a score is a
    radix ranking, so even all-distinct scores never meet in one task.
    """
    by = list(by)
    scores = df.groupBy(*by, p).agg(
        F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg")
    )
    ranked = scale.with_total_before(scores, by, p, "_neg", "_below")
    won = F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / 2)
    out = ranked.groupBy(*by).agg(
        F.sum(won).alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n")
    )
    pairs = F.col("_p").cast("double") * F.col("_n")
    return out.select(*by, F.try_divide("_won", pairs).alias("roc_auc"))


def classifier_metrics(
    df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", yhat: str = "yhat",
    with_auc: bool = True,
) -> DataFrame:
    """Accuracy, AUC, log loss, Brier score and confusion counts per group."""
    by, t, h, s = list(by), F.col(y), F.col(yhat), F.col(p)
    count = lambda a, b: F.count_if((t == a) & (h == b))
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg((t == h).cast("double")).alias("accuracy"),
        _log_loss(t, s).alias("log_loss"),
        F.avg((s - t) * (s - t)).alias("brier_score"),
        count(1, 1).alias("true_positive"), count(0, 0).alias("true_negative"),
        count(0, 1).alias("false_positive"), count(1, 0).alias("false_negative"),
    )
    if by:
        return out.join(roc_auc(df, by, y, p), by) if with_auc else out
    return (one_row(out, roc_auc(df, [], y, p)) if with_auc else out).filter("row_count > 0")


def one_row(*parts: DataFrame) -> DataFrame:
    """Side by side what several one-row tables of numbers say; their columns must differ."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def phase_metrics(
    df: DataFrame, by: Sequence[str] = (), seconds: str = "seconds_remaining_game",
    y: str = "y", p: str = "p", yhat: str = "yhat",
) -> DataFrame:
    """Quality per game phase; log loss is null where a phase has one class only."""
    rows = df.withColumn("phase", X.game_phase(seconds))
    t = F.col(y)
    both = F.min(t) != F.max(t)
    return rows.groupBy(*by, "phase").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg((t == F.col(yhat)).cast("double")).alias("accuracy"),
        F.when(both, _log_loss(t, F.col(p))).alias("log_loss"),
        F.avg((F.col(p) - t) * (F.col(p) - t)).alias("brier_score"),
    )


def _bucket(p: Column, edges: Sequence[float], right_closed: bool) -> Column:
    names = [f"{a:.1f}-{b:.1f}" for a, b in zip(edges, edges[1:])]
    pairs = list(zip(edges[1:], names))
    if right_closed:
        out = reduce(lambda w, en: w.when(p <= en[0], en[1]), pairs, F.when(p < edges[0], None))
    else:
        out = reduce(lambda w, en: w.when(p < en[0], en[1]), pairs[:-1], F.when(p < edges[0], None))
        out = out.when(p <= edges[-1], names[-1])
    return out


def calibration(
    df: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p", bins: int = 10
) -> DataFrame:
    """Predicted against observed rate in right-closed buckets; empty buckets do not appear."""
    step = 1.0 / bins
    edges = [i * step for i in range(bins)] + [1.0]
    rows = df.withColumn("probability_bucket", _bucket(F.col(p), edges, right_closed=True))
    return rows.filter("probability_bucket IS NOT NULL").groupBy(*by, "probability_bucket").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(p).alias("avg_predicted_probability"),
        F.avg(F.col(y).cast("double")).alias("actual_home_win_rate"),
    )


def probability_buckets(df: DataFrame) -> DataFrame:
    """Labelled predictions in left-closed buckets (the last one takes 1.0 too)."""
    p = X.number("home_win_probability")
    rows = df.filter(F.col(LABEL).isNotNull() & p.isNotNull()).withColumn("_p", p)
    rows = rows.withColumn(
        "probability_bucket", _bucket(F.col("_p"), BUCKET_EDGES, right_closed=False)
    )
    return rows.filter("probability_bucket IS NOT NULL").groupBy("probability_bucket").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg("_p").alias("avg_predicted_home_probability"),
        F.avg(F.col(LABEL).cast("double")).alias("actual_home_win_rate"),
    )


# ---- summaries of prediction tables --------------------------------------------------------
def _correct(df: DataFrame) -> Column:
    return F.when(F.col(LABEL).isNotNull(), F.col("prediction_correct").cast("double"))


def accuracy_if_labelled(df: DataFrame) -> DataFrame:
    """Share of correct predictions among those that can be judged; null when none can."""
    return df.agg(F.avg(_correct(df)).alias("accuracy"))


def long_metrics(wide: DataFrame, section: str, text_columns: Sequence[str] = ()) -> DataFrame:
    """One wide row -> (section, metric, value, text); metrics without a value are left out."""
    numbers = [c for c in wide.columns if c not in text_columns]
    out = wide.select(*[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(
        [], numbers, "metric", "value"
    ).withColumn("text", F.lit(None).cast("string"))
    if text_columns:
        words = wide.select(*text_columns).unpivot([], list(text_columns), "metric", "text")
        out = out.unionByName(words.withColumn("value", F.lit(None).cast("double")))
    out = out.filter(F.col("value").isNotNull() | F.col("text").isNotNull())
    return out.select(F.lit(section).alias("section"), "metric", "value", "text")


def _first_best(value: Column, distance: Column) -> Column:
    """Value of the row with the smallest distance; earliest game on ties."""
    return F.min_by(value, F.struct(distance, F.col("game_date"), F.col("game_id")))


def _averages() -> dict[str, Column]:
    p, q = F.col("home_win_probability"), F.col("away_win_probability")
    return {
        "avg_home_win_probability": F.avg(p),
        "avg_away_win_probability": F.avg(q),
        "avg_confidence": F.avg(X.confidence(p, q)),
        "home_pick_rate": F.avg((F.col("predicted_label") == 1).cast("double")),
        "away_pick_rate": F.avg((F.col("predicted_label") == 0).cast("double")),
    }


def pregame_summary(df: DataFrame) -> DataFrame:
    p, q = F.col("home_win_probability"), F.col("away_win_probability")
    conf, even = -X.confidence(p, q), F.abs(p - 0.5)
    ok, label = _correct(df), X.game_label()
    aggs = {
        "total_predictions": F.count(F.lit(1)),
        "labeled_predictions": F.count(LABEL),
        **_averages(),
        "prediction_accuracy": F.avg(ok),
        "correct_predictions": F.when(F.count(ok) > 0, F.count_if(ok == 1)),
        "incorrect_predictions": F.when(F.count(ok) > 0, F.count_if(ok == 0)),
        "most_confident_prediction": _first_best(label, conf),
        "most_confident_home_probability": _first_best(p, conf),
        "closest_prediction_to_50_50": _first_best(label, even),
        "closest_home_probability": _first_best(p, even),
    }
    wide = df.agg(*[c.alias(n) for n, c in aggs.items()])
    texts = ["most_confident_prediction", "closest_prediction_to_50_50"]
    return long_metrics(wide, "summary", texts)


def filtered_summary(df: DataFrame) -> DataFrame:
    """Summary of a filtered selection; confidence is the distance from even."""
    p = F.col("home_win_probability")
    even, label = F.abs(p - 0.5), X.game_label()
    wide = df.agg(
        F.count(F.lit(1)).alias("game_count"),
        F.avg(p).alias("avg_home_win_probability"),
        F.avg(_correct(df)).alias("prediction_accuracy"),
        _first_best(label, -even).alias("most_confident_game"),
        _first_best(p, -even).alias("most_confident_home_prob"),
        _first_best(label, even).alias("closest_game"),
        _first_best(p, even).alias("closest_home_prob"),
    )
    return long_metrics(wide, "filtered", ["most_confident_game", "closest_game"])


def live_summary(df: DataFrame) -> DataFrame:
    """Event-weighted summary over all scored events."""
    aggs = {
        "total_event_predictions": F.count(F.lit(1)),
        "unique_games": F.countDistinct("game_id"),
        **_averages(),
        "prediction_accuracy": F.avg(_correct(df)),
    }
    return long_metrics(df.agg(*[c.alias(n) for n, c in aggs.items()]), "event_level")


def final_event_summary(final_events: DataFrame) -> DataFrame:
    """Summary of the last scored event of each game."""
    aggs = {
        "total_games": F.count(F.lit(1)),
        "avg_final_confidence": F.avg(X.confidence("home_win_probability", "away_win_probability")),
        "number_home_final_predictions": F.count_if(F.col("predicted_label") == 1),
        "number_away_final_predictions": F.count_if(F.col("predicted_label") == 0),
        "final_event_accuracy": F.avg(_correct(final_events)),
    }
    return long_metrics(final_events.agg(*[c.alias(n) for n, c in aggs.items()]), "final_event")


def team_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy per team over its labelled games; a game counts once for each of its teams."""
    rows = df.filter(F.col(LABEL).isNotNull() & F.col("prediction_correct").isNotNull())
    team = F.explode(F.array_distinct(F.array("home_team", "away_team"))).alias("team")
    long = rows.select(team, "home_team", "away_team", "prediction_correct")
    return long.groupBy("team").agg(
        F.count_if(F.col("team") == F.col("home_team")).alias("games_as_home"),
        F.count_if(F.col("team") == F.col("away_team")).alias("games_as_away"),
        F.count(F.lit(1)).alias("total_games"),
        F.avg(F.col("prediction_correct").cast("double")).alias("accuracy"),
    )


# ---- reports ---------------------------------------------------------------------------------
def _section(df: DataFrame, section: str, note: str, metric=None) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), (metric if metric is not None else F.col("metric")).alias("metric"),
        F.col("value").cast("double").alias("value"),
        (F.col("text") if "text" in df.columns else F.lit(None).cast("string")).alias("text"),
        F.lit(note).alias("notes"),
    )


def evaluation_summary(
    pregame_metrics: DataFrame | None, live_metrics: DataFrame | None,
    phases: DataFrame | None, summaries: Mapping[str, DataFrame],
    counts: DataFrame | None, manual: DataFrame | None,
) -> DataFrame:
    """Union of all metric families as (section, metric, value, text, notes)."""
    parts = []
    wanted = {
        "pregame_model_training": (pregame_metrics, [*CORE_METRICS, "n_train", "n_test", "n_features"]),
        "live_model_training": (live_metrics, [*CORE_METRICS, "train_games", "test_games", "n_features"]),
    }
    for section, (df, names) in wanted.items():
        if df is not None:
            names = [n for n in names if n in df.columns]
            parts.append(_section(long_metrics(df.select(*names), section), section, TEST_NOTE))
    if phases is not None:
        typed = phases.select("phase", *[
            F.col(c).cast("double").alias(c) for c in [*PHASE_METRICS, "row_count"]
        ])
        long = typed.unpivot(["phase"], [*PHASE_METRICS, "row_count"], "metric", "value")
        name = F.concat_ws("_", "phase", "metric")
        parts.append(_section(long.filter("value IS NOT NULL"), "live_model_training", TEST_NOTE, name))
    notes = {
        "pregame_predictions_full_dataset": REFERENCE_NOTE,
        "live_predictions_event_level": EVENT_NOTE,
        "live_predictions_final_event": REFERENCE_NOTE,
    }
    for section, df in summaries.items():
        parts.append(_section(df, section, notes.get(section, "")))
    if counts is not None:
        parts.append(_section(counts, "data_coverage", ""))
    if manual is not None:
        parts.append(_section(manual, "manual_overrides", ""))
    return reduce(DataFrame.unionByName, parts)


def metric_value(long: DataFrame, section: str, metric: str) -> DataFrame:
    """Value of one metric in a long report."""
    return long.filter((F.col("section") == section) & (F.col("metric") == metric)).select("value")


# ---- comparing model versions ---------------------------------------------------------------------
def _long_by_version(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    typed = df.select("model_version", *keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = typed.unpivot(["model_version", *keys], list(metrics), "metric", "value")
    return long.filter(F.col("value").isNotNull())


def metric_detail(df: DataFrame) -> DataFrame:
    """Long form of the metric report of every model version."""
    return _long_by_version(df, [], [*CORE_METRICS, *X.CONFUSION_METRICS])


def compare_versions(
    df: DataFrame, old: str, new: str, keys: Sequence[str] = (),
    metrics: Sequence[str] = (*CORE_METRICS, *X.CONFUSION_METRICS),
) -> DataFrame:
    """Metric by metric (and key): old value, new value, difference and what it means."""
    long = _long_by_version(df, keys, metrics)
    on = [*keys, "metric"]
    one = lambda v, name: long.filter(F.col("model_version") == v).select(
        *on, F.col("value").alias(name)
    )
    both = one(old, "single_season_value").join(one(new, "multiseason_value"), on, "full")
    both = both.withColumn("difference", F.col("multiseason_value") - F.col("single_season_value"))
    text = F.trim(F.concat_ws(" ", X.polarity_text("metric", "difference"), F.lit(SETUP_NOTE)))
    return both.withColumn("interpretation", text)


PHASES_NOT_THERE = {  # fixed values: which of the two reports are there -> sentence
    (False, False): "Phase comparison unavailable — no phase reports found.",
    (False, True): "Phase comparison incomplete — single-season phase report missing.",
    (True, False): "Phase comparison incomplete — multi-season phase report missing.",
    (True, True): "Phase reports exist but share no comparable metrics.",
}


def phase_comparison(spark: SparkSession, old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """Phase reports of two versions compared; one row that says why where that is not possible."""
    names = ["phase", "metric", "single_season_value", "multiseason_value", "difference", "interpretation"]
    reason = PHASES_NOT_THERE[old is not None, new is not None]
    kinds = "phase string, metric string, single_season_value double, multiseason_value double, difference double"
    why = spark.createDataFrame([("all", "n/a", None, None, None, reason)], f"{kinds}, interpretation string")
    if old is None or new is None:
        return why
    both = old.withColumn("model_version", F.lit("old")).unionByName(
        new.withColumn("model_version", F.lit("new")), allowMissingColumns=True)
    rows = compare_versions(both, "old", "new", ["phase"], PHASE_METRICS).select(*names)
    return why if rows.isEmpty() else rows


def calibration_comparison(df: DataFrame, by: Sequence[str] = ("model_version",)) -> DataFrame:
    """Calibration tables of all versions stacked, with the absolute error per bucket."""
    table = calibration(df, by)
    return table.select(
        *by, F.col("probability_bucket").alias("bin"),
        F.col("avg_predicted_probability").alias("mean_predicted_probability"),
        F.col("actual_home_win_rate").alias("observed_rate"),
        F.col("row_count").alias("count"),
        F.abs(F.col("avg_predicted_probability") - F.col("actual_home_win_rate"))
        .alias("calibration_error"),
    )
