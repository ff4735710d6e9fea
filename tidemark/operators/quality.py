"""Structural checks: column contracts, null splits, probability range, leakage, overrides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import exprs as X
from tidemark.operators import scale


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    present = set(df.columns)
    return [c for c in required if c not in present]


def require_columns(df: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    """Fail before any job runs when a column is absent."""
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}. Found: {df.columns}")
    return df


def split_valid(
    df: DataFrame, non_null: Sequence[str], required: Sequence[str] = (), name: str = "table"
) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid): a row is invalid when any of the non-null columns is null."""
    require_columns(df, [*required, *non_null], name)
    bad = X.any_null(*non_null)
    return df.filter(~bad), df.filter(bad)


def probability_violations(df: DataFrame, columns: Sequence[str], shown: int = 5) -> DataFrame:
    """Offending values per column: null, not a number, or outside [0, 1].

    ``offending_rows`` counts all of them; ``shown`` lists the smallest few.
    """
    p = {c: F.col(c).try_cast("double") for c in columns}
    broken = {c: v.isNull() | F.isnan(v) | (v < 0) | (v > 1) for c, v in p.items()}
    some = df.filter(reduce(lambda a, b: a | b, broken.values()))
    shown_as = {
        c: F.when(bad, F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(c)
        for c, bad in broken.items()
    }
    long = some.select(*shown_as.values()).unpivot([], list(columns), "column_name", "value")
    bad = long.filter("value IS NOT NULL")
    counts = bad.groupBy("column_name").agg(F.count(F.lit(1)).alias("offending_rows"))
    few = scale.top_per_key(bad, ["column_name"], [F.col("value").asc()], shown)
    few = few.groupBy("column_name").agg(
        F.array_join(F.array_sort(F.collect_list("value")), ", ").alias("shown")
    )
    return counts.join(few, "column_name")


def check_probabilities(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise with the offending values (at most one report row per column reaches the driver)."""
    rows = probability_violations(df, columns).collect()
    if rows:
        text = "; ".join(f"{r.column_name}: {r.offending_rows} bad ({r.shown})" for r in rows)
        raise ValueError(f"Probabilities must be numbers in [0, 1]. {text}")


def check_no_leakage(features: Sequence[str], forbidden: Sequence[str]) -> None:
    leaked = sorted(set(features) & set(forbidden))
    if leaked:
        raise ValueError(f"Target leakage: forbidden feature columns {leaked}")


# ---- schedule overrides -----------------------------------------------------------------
def normalize_overrides(df: DataFrame) -> DataFrame:
    """Blank spellings to empty text, lower-case status and source, canonical season type."""
    blank = lambda c: F.coalesce(X.blank_to_null(c), F.lit(""))
    playoffs = F.lower(X.strip("season_type")).isin("playoffs", "playoff")
    return df.withColumns({
        "finals_game_number": X.number("finals_game_number").cast("int"),
        **{c: blank(c) for c in ("game_id", "home_team_id", "away_team_id")},
        **{c: F.lower(X.strip(c)) for c in ("status", "source")},
        "season_type": F.when(playoffs, X.SEASON_TYPE_PLAYOFFS).otherwise(F.col("season_type")),
    })


def override_violations(df: DataFrame) -> DataFrame:
    """All rule breaks as (rule, key, detail); an empty result means the overrides are usable."""
    spark = df.sparkSession
    have, want = set(df.columns), schemas.OVERRIDE_COLUMNS
    shape = [("forbidden_column", c) for c in df.columns if c in schemas.OVERRIDE_FORBIDDEN]
    shape += [
        ("unexpected_column", c) for c in df.columns
        if c not in want and c not in schemas.OVERRIDE_FORBIDDEN
    ]
    shape += [("missing_column", c) for c in want if c not in have]
    out = spark.createDataFrame(
        [(rule, "", c) for rule, c in shape], "rule string, key string, detail string"
    )
    if any(rule == "missing_column" for rule, _ in shape):
        return out
    key = F.concat_ws(" ", "season", F.col("finals_game_number").cast("string"))
    status, source = F.lower(X.strip("status")), F.lower(X.strip("source"))

    def rows(rule, condition, detail):
        return df.filter(condition).select(
            F.lit(rule).alias("rule"), key.alias("key"), X.as_col(detail).alias("detail")
        )

    named = lambda c: F.coalesce(c, F.lit("")) != ""
    duplicates = (
        df.groupBy("season", "finals_game_number").agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.lit("duplicate_key").alias("rule"), key.alias("key"),
                F.col("n").cast("string").alias("detail"))
    )
    needs_all = status.isin("scheduled", "if_necessary_scheduled")
    parts = [
        duplicates,
        rows("invalid_status", named(status) & ~status.isin(*schemas.OVERRIDE_STATUSES), status),
        rows("invalid_source", named(source) & ~source.isin(*schemas.OVERRIDE_SOURCES), source),
    ]
    absent = F.filter(
        F.array(*[
            F.when(F.coalesce(X.strip(c), F.lit("")) == "", F.lit(c))
            for c in schemas.SCHEDULED_REQUIRED
        ]),
        lambda c: c.isNotNull(),
    )
    broken = df.filter(needs_all).withColumn("_absent", F.explode(absent))
    parts.append(broken.select(
        F.lit("missing_required").alias("rule"), key.alias("key"), F.col("_absent").alias("detail")
    ))
    return reduce(DataFrame.unionByName, parts, out)


# ---- dataset contracts ------------------------------------------------------------------
def contract_rows(
    spark, datasets: Mapping[str, DataFrame | None], required: Mapping[str, Sequence[str]],
    optional: Sequence[str] = (),
) -> DataFrame:
    """One row per dataset and check; emptiness is probed with a single-row read."""
    rows = []
    for name, df in datasets.items():
        if df is None:
            status = "not_applicable" if name in optional else "fail"
            rows.append((name, "exists", status, "table missing"))
            continue
        rows.append((name, "exists", "pass", ""))
        empty = df.isEmpty()
        rows.append((name, "has_rows", "warning" if empty else "pass", ""))
        absent = missing_columns(df, required.get(name, ()))
        rows.append((name, "columns", "fail" if absent else "pass", ", ".join(absent)))
    return spark.createDataFrame(
        rows, "dataset string, check string, status string, details string"
    )
