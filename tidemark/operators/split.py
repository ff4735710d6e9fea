"""Train/test splits in time order; whole games stay on one side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import scale


def held_out(total, test_size: float) -> Column:
    """Rows to hold out: banker's rounding, at least one on each side, none below two rows."""
    n = F.col(total) if isinstance(total, str) else total
    wanted = F.bround(n * F.lit(float(test_size)), 0)
    return F.when(n >= 2, F.greatest(F.lit(1), F.least(wanted, n - 1))).otherwise(0).cast("long")


def _check(test_size: float) -> None:
    if not 0.0 < test_size < 1.0:
        raise ValueError(f"test_size must be between 0 and 1, got {test_size}")


def _boundary(keys: DataFrame, date_col: str, test_size: float):
    """(date, training rows of that date) where the test side begins; None if nothing is held out.

    Only one row per date is ordered.
    """
    dates = keys.groupBy(date_col).agg(F.count(F.lit(1)).alias("_n"))
    through = F.sum("_n").over(Window.orderBy(F.col(date_col).asc_nulls_last()))
    placed = dates.withColumns({
        "_before": through - F.col("_n"), "_total": F.sum("_n").over(Window.partitionBy(F.lit(1))),
    })
    cut = F.col("_total") - held_out("_total", test_size)
    row = placed.filter((F.col("_before") <= cut) & (cut < F.col("_before") + F.col("_n"))).select(
        F.col(date_col).alias("date"), (cut - F.col("_before")).alias("kept")).head()
    return None if row is None else (row.date, row.kept)


def mark_sides(keys: DataFrame, date_col: str, id_col: str, test_size: float) -> DataFrame:
    """Add ``is_test`` to a table of distinct keys: the latest share is the test side.

    Rows are counted per date; ids are ranked on the one date the cut falls into, and the side is a
    comparison of date and id. Undated rows come last, ids decide on equal dates.
    """
    _check(test_size)
    found = _boundary(keys, date_col, test_size)
    if found is None:
        return keys.withColumn("is_test", F.lit(False))
    day, kept = found
    same = F.col(date_col).eqNullSafe(F.lit(day))
    later = F.lit(False) if day is None else F.col(date_col).isNull() | (F.col(date_col) > F.lit(day))
    if not kept:
        return keys.withColumn("is_test", F.coalesce(same | later, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(date_col).orderBy(F.col(id_col).asc_nulls_first()))
    last = keys.filter(same).select(date_col, id_col).withColumn("_rank", rank)
    last = last.filter(F.col("_rank") == kept).head()[id_col]
    beyond = F.col(id_col).isNotNull() if last is None else F.col(id_col) > F.lit(last)
    return keys.withColumn("is_test", F.coalesce(later | (same & beyond), F.lit(False)))


def chronological_split(
    df: DataFrame, date_col: str = "game_date", test_size: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Earliest rows to train, latest to test, for one-row-per-game tables."""
    marked = mark_sides(df, date_col, "game_id", test_size)
    return (
        marked.filter(~F.col("is_test")).drop("is_test"),
        marked.filter("is_test").drop("is_test"),
    )


def mark_games(
    df: DataFrame, test_size: float = 0.2, date_col: str = "game_date",
) -> DataFrame:
    """Event rows with the side of their game; only the distinct games are ordered."""
    order = "event_num" if "event_num" in df.columns else date_col
    games = df.groupBy("game_id").agg(F.min_by(date_col, order).alias(date_col))
    sides = mark_sides(games, date_col, "game_id", test_size).select("game_id", "is_test")
    return scale.lookup_join(df, sides, ["game_id"], how="inner")


def game_split(
    df: DataFrame, test_size: float = 0.2, date_col: str = "game_date"
) -> tuple[DataFrame, DataFrame]:
    marked = mark_games(df, test_size, date_col)
    return (
        marked.filter(~F.col("is_test")).drop("is_test"),
        marked.filter("is_test").drop("is_test"),
    )


def season_split(
    df: DataFrame, train: Sequence[str], test: str | Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Split by season label; the two lists may not share a season."""
    test = [test] if isinstance(test, str) else list(test)
    shared = sorted(set(train) & set(test))
    if not train or not test or shared:
        raise ValueError(f"train and test seasons must be non-empty and disjoint; shared: {shared}")
    return df.filter(F.col("season").isin(*train)), df.filter(F.col("season").isin(*test))


def shared_games(train: DataFrame, test: DataFrame) -> DataFrame:
    """Games on both sides; must be empty."""
    return train.select("game_id").distinct().join(
        test.select("game_id").distinct(), "game_id", "left_semi"
    )


def check_split(train: DataFrame, test: DataFrame) -> None:
    leaked = [r.game_id for r in shared_games(train, test).orderBy("game_id").limit(5).collect()]
    if leaked:
        raise ValueError(f"games on both sides of the split, for example {leaked}")
