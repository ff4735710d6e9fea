"""Logistic win-probability models: features, pipeline, training report, scoring."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import exprs as X
from tidemark.operators import metrics, quality, scale

TARGET = "home_team_won"
PREGAME_INPUT_FORBIDDEN = ["home_team_won", "home_score", "away_score", "winner"]
LIVE_INPUT_FORBIDDEN = ["home_team_won", "final_home_score", "final_away_score", "winner"]


@dataclass
class Manifest:
    """Which columns a model reads, and the value that stands in for a missing category."""

    numeric: list[str]
    categorical: list[str] = field(default_factory=list)
    modes: dict[str, str] = field(default_factory=dict)

    @property
    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @classmethod
    def of(cls, artifact: list | dict) -> Manifest:
        """From a plain list of columns or a dict with ``all_features``."""
        if isinstance(artifact, dict):
            if "all_features" not in artifact:
                raise ValueError("feature dict must contain 'all_features'")
            categorical = list(artifact.get("categorical_features", []))
            numeric = list(artifact.get("numeric_features", []))
            rest = [c for c in artifact["all_features"] if c not in {*categorical, *numeric}]
            return cls(numeric + rest, categorical)
        return cls(list(artifact))


@dataclass
class Scorer:
    manifest: Manifest
    model: PipelineModel

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.active()
        text = spark.createDataFrame([(json.dumps(asdict(self.manifest)),)], "value string")
        text.write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark, path: str) -> Scorer:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
        return cls(Manifest(**manifest), PipelineModel.load(f"{path}/model"))


# ---- features -------------------------------------------------------------------------------
def pregame_manifest(df: DataFrame) -> Manifest:
    have = set(df.columns)
    manifest = Manifest(
        [c for c in schemas.PREGAME_NUMERIC if c in have],
        [c for c in schemas.PREGAME_CATEGORICAL if c in have],
    )
    quality.check_no_leakage(manifest.all, schemas.PREGAME_FORBIDDEN)
    return manifest


def live_manifest(df: DataFrame) -> Manifest:
    """Event kinds are numeric features only when their column is numeric."""
    types = {f.name: f.dataType for f in df.schema.fields}
    present = [c for c in schemas.LIVE_NUMERIC if c in types]
    worded = [
        c for c in present
        if c in schemas.LIVE_EITHER_TYPE and not isinstance(types[c], T.NumericType)
    ]
    manifest = Manifest(
        [c for c in present if c not in worded],
        [*worded, *[c for c in schemas.LIVE_CATEGORICAL if c in types]],
    )
    quality.check_no_leakage(manifest.all, schemas.LIVE_FORBIDDEN)
    return manifest


def training_rows(df: DataFrame) -> DataFrame:
    quality.require_columns(df, [TARGET], "training data")
    return df.dropna(subset=[TARGET]).withColumn(TARGET, F.col(TARGET).cast("int"))


def typed_features(df: DataFrame, manifest: Manifest) -> DataFrame:
    """Numbers as doubles, categories as text with the usual value where they are missing."""
    numbers = {c: F.col(c).cast("double") for c in manifest.numeric}
    words = {
        c: F.coalesce(F.col(c).cast("string"), F.lit(manifest.modes.get(c)))
        for c in manifest.categorical
    }
    return df.withColumns({**numbers, **words}) if numbers or words else df


def category_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Values of every category column, the most frequent first (smallest value on ties). The values
    are what the model has a weight for, so all of them reach the driver."""
    if not columns:
        return {}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    long = long.unpivot([], list(columns), "column_name", "value").filter("value IS NOT NULL")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    found = sorted(counts.collect(), key=lambda r: (r.column_name, -r.n, r.value))
    return {c: [r.value for r in found if r.column_name == c] for c in columns}


@dataclass
class Moments:
    """What one aggregate says about a number column once its gaps hold the median."""

    median: float
    mean: float
    deviation: float


def _median(value: Column, error: float) -> Column:
    """Median from a mergeable quantile sketch whose rank error is below ``error``; 0: exact."""
    if error <= 0:
        return F.percentile(value, 0.5)
    size = min(max(int((2.3 / error) ** (1 / 0.9)) + 1, 8), 65535)
    sketch = F.kll_sketch_agg_double(value, F.lit(size))
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(0.5)))


def moments(df: DataFrame, columns: Sequence[str], error: float) -> tuple[int, dict[str, Moments]]:
    """(rows, moments of the columns that have a value), all from one pass over the rows.

    Sums are taken over the values there are; filling the gaps with the median moves mean and
    deviation in a way that follows from the counts.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, v in enumerate(value.values()):
        aggs += [F.count(v).alias(f"c{k}"), F.avg(v).alias(f"a{k}"), F.var_pop(v).alias(f"v{k}"),
                 _median(v, error).alias(f"m{k}")]
    row = df.agg(*aggs).first()
    n, out = row["n"], {}
    for k, c in enumerate(columns):
        there, mean, spread, median = (row[f"{x}{k}"] for x in "cavm")
        if not there:
            continue
        gaps, off = n - there, median - mean
        squares = spread * there + off * off * there * gaps / n
        out[c] = Moments(median, mean + off * gaps / n, (squares / max(n - 1, 1)) ** 0.5)
    return n, out


# ---- training -------------------------------------------------------------------------------
def scaled(found: dict[str, Moments]) -> SQLTransformer:
    """Median fill and scaling of all number columns as one projection."""
    terms = []
    for c, m in found.items():
        x = f"coalesce(if(isnan(`{c}`), NULL, `{c}`), {m.median!r}D)"
        term = f"({x} - {m.mean!r}D) / {m.deviation!r}D" if m.deviation > 0 else "0D"
        terms.append(f"{term} AS `{c}__scaled`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__")


def features_of(found: dict[str, Moments], values: dict[str, list[str]], sample: DataFrame) -> list[Transformer]:
    """The stages that make one feature vector; none of them looks at the rows.

    An unseen category encodes to all zeros: it takes the slot that dropLast removes.
    """
    stages: list[Transformer] = []
    inputs = [f"{c}__scaled" for c in found]
    if found:
        stages.append(scaled(found))
    if values:
        index, hot = ([f"{c}__{end}" for c in values] for end in ("index", "hot"))
        indexers = [
            StringIndexerModel.from_labels(labels, c, i, handleInvalid="keep")
            for (c, labels), i in zip(values.items(), index)
        ]
        # Sizes come from the indexers' labels, so this fit runs no job.
        encoder = OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True)
        coded = PipelineModel(indexers).transform(sample.select(*values))
        stages += [*indexers, encoder.fit(coded)]
        inputs += hot
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="__features")]


def fit(train: DataFrame, manifest: Manifest, c: float = 1.0, median_error: float = 1e-3,
        max_iter: int = 1000) -> Scorer:
    """Ridge logistic regression on labelled rows; columns with no value at all are left out.

    The rows are read for one aggregate of all number columns and one of all categories; the optimiser
    then works on a persisted vector column.
    """
    rows = training_rows(train).select(*manifest.all, TARGET)
    n, found = moments(rows, manifest.numeric, median_error)
    if n < 2:
        raise ValueError("need at least two labelled rows to train")
    values = {k: v for k, v in category_counts(rows, manifest.categorical).items() if v}
    used = Manifest([c for c in manifest.numeric if c in found], list(values), {k: v[0] for k, v in values.items()})
    typed = typed_features(rows, used)
    stages = features_of(found, values, typed)
    vectors = PipelineModel(stages).transform(typed).select("__features", F.col(TARGET).cast("double").alias(TARGET))
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        regression = LogisticRegression(
            featuresCol="__features", labelCol=TARGET, probabilityCol="__probability",
            rawPredictionCol="__raw", predictionCol="__prediction",
            regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter,
        )
        return Scorer(used, PipelineModel([*stages, regression.fit(vectors)]))
    finally:
        vectors.unpersist()


def score(df: DataFrame, scorer: Scorer, forbidden: Sequence[str] = PREGAME_INPUT_FORBIDDEN,
          name: str = "features") -> DataFrame:
    """Add ``home_win_probability``; a map-only stage that works on streams as well."""
    quality.require_columns(df, scorer.manifest.all, name)
    quality.check_no_leakage(scorer.manifest.all, forbidden)
    inputs = F.struct(*df.columns)
    rows = df.select(inputs.alias("__row"), *scorer.manifest.all)
    rows = scorer.model.transform(typed_features(rows, scorer.manifest))
    p = vector_to_array("__probability")[1]
    return rows.select("__row.*", p.alias("home_win_probability"))


def prediction_columns(scored: DataFrame) -> DataFrame:
    """Complement, label (0.5 counts as home), winner name, and correctness where it is known."""
    p = F.col("home_win_probability")
    label = (p >= 0.5).cast("int")
    actual = X.number(TARGET).cast("int") if TARGET in scored.columns else F.lit(None).cast("int")
    return scored.withColumns({
        "away_win_probability": 1.0 - p,
        "predicted_label": label,
        "predicted_winner": F.when(p >= 0.5, F.col("home_team")).otherwise(F.col("away_team")),
        "actual_home_team_won": actual,
        "prediction_correct": label == actual,
    })


def _select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns])


def predict_pregame(features: DataFrame, scorer: Scorer) -> DataFrame:
    scored = prediction_columns(score(features, scorer, PREGAME_INPUT_FORBIDDEN))
    return _select(scored, schemas.PREGAME_PREDICTION_COLUMNS)


def predict_live(features: DataFrame, scorer: Scorer) -> DataFrame:
    scored = prediction_columns(score(features, scorer, LIVE_INPUT_FORBIDDEN))
    return _select(scored, schemas.LIVE_PREDICTION_COLUMNS)


@dataclass
class Training:
    scorer: Scorer
    metrics: DataFrame
    calibration: DataFrame
    phases: DataFrame | None


def train_and_report(
    train: DataFrame, test: DataFrame, manifest: Manifest, live: bool = False, **options
) -> Training:
    """Fit on train, judge on test: metrics row, calibration table and, for events, phases."""
    every = train.select("game_id", TARGET).unionByName(test.select("game_id", TARGET))
    totals = every.agg(
        F.count(F.lit(1)).alias("n_total_rows"), F.count(TARGET).alias("n_used_rows"),
        F.count_if(F.col(TARGET).isNull()).alias("n_dropped_missing_target"),
        F.countDistinct(F.when(F.col(TARGET).isNotNull(), F.col("game_id"))).alias("n_unique_games"),
    )
    train, test = training_rows(train), training_rows(test)
    if live:
        games = train.select("game_id").unionByName(test.select("game_id")).distinct()
        if len(games.limit(2).collect()) < 2:
            raise ValueError("need at least two games to train")
    scorer = fit(train, manifest, **options)
    forbidden = LIVE_INPUT_FORBIDDEN if live else PREGAME_INPUT_FORBIDDEN
    judged = score(test, scorer, forbidden).select(
        "*", F.col(TARGET).alias("y"), F.col("home_win_probability").alias("p"),
        (F.col("home_win_probability") > 0.5).cast("int").alias("yhat"),
    )
    sizes = train.agg(
        F.count(F.lit(1)).alias("n_train"), F.countDistinct("game_id").alias("train_games")
    )
    tested = test.agg(F.countDistinct("game_id").alias("test_games"))
    row = metrics.one_row(sizes, metrics.classifier_metrics(judged), tested, totals).select(
        F.lit("logistic_regression").alias("model_type"),
        "n_total_rows", "n_used_rows", "n_dropped_missing_target", "n_unique_games", "n_train",
        F.col("row_count").alias("n_test"), "train_games", "test_games",
        F.lit(len(scorer.manifest.all)).alias("n_features"),
        *metrics.CORE_METRICS, *X.CONFUSION_METRICS,
    )
    phases = metrics.phase_metrics(judged) if live else None
    return Training(scorer, row, metrics.calibration(judged), phases)
