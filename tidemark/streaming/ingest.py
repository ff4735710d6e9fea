"""The batch rules on arriving files: incremental ingest, running state, scoring.

Every sink below is a keyed merge or a folder named after its batch, so a batch that runs twice
after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import schemas
from tidemark.operators import coverage, live, model, quality, scale
from tidemark.sources import tables

#: Games of a storage bucket: about a season, so that a bucket is a file of some MB.
BUCKET_GAMES = 2_000
#: The same for tables of a row, or a row per block of events, and game.
SUMMARY_GAMES = 25_600
UNNUMBERED = 512


def read_stream(
    spark: SparkSession, path: str, schema, files_per_batch: int = 1000, fmt: str = "parquet"
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def with_bucket(df: DataFrame, games: int = BUCKET_GAMES) -> DataFrame:
    """Storage bucket of a game: ``games`` consecutive ids share one.

    Ids follow the calendar, so a batch of new games touches the last buckets and leaves the others
    alone. Ids that are no numbers are spread by hash over buckets below zero.
    """
    number = F.col("game_id").try_cast("long")
    spread = -1 - F.pmod(F.hash("game_id"), F.lit(UNNUMBERED))
    return df.withColumn("bucket", F.coalesce(F.floor(number / games), spread).cast("long"))


def ingest_batch(
    table: str, quarantine: str, bucket_games: int = BUCKET_GAMES, then: Callable | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None, first: Callable | None = None,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: split invalid rows off, merge the rest by (game, event).

    ``prepare`` turns feed rows into event rows first (``operators.ingest.normalize_plays``);
    ``first`` sees the rows before they are merged, ``then`` after.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = (batch if prepare is None else prepare(batch)).persist()
        try:
            good, bad = quality.split_valid(batch, schemas.PLAY_NON_NULL)
            if not bad.isEmpty():
                tables.overwrite(bad, f"{quarantine}/batch={batch_id}")
            if not good.isEmpty():
                rows = with_bucket(good, bucket_games)
                if first is not None:
                    first(rows, batch_id)
                tables.upsert(table, rows, live.EVENT_KEY, ["bucket"])
                if then is not None:
                    then(rows, batch_id)
        finally:
            batch.unpersist()

    return run


def touched_events(rows: DataFrame, table: str) -> DataFrame:
    """Stored events of the games in a batch, read from their buckets only."""
    games = rows.select("game_id").distinct()
    stored = tables.read_table(rows.sparkSession, table, rows.schema)
    stored = stored.filter(tables.partitions_of(rows, ["bucket"]))
    return scale.lookup_join(
        stored, games, ["game_id"], how="inner"
    )


def refresh_live_state(
    table: str, games: DataFrame, features: str, block_rows: int = scale.DEFAULT_BLOCK_ROWS,
    bucket_games: int = BUCKET_GAMES,
) -> Callable[[DataFrame, int], None]:
    """After a merge, rebuild the running state of the games the batch touched; the state table is
    bucketed like the events.

    Same code as the batch job, so a late, lower score cannot rewind the state.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        events = touched_events(rows, table).drop("bucket")
        state = live.live_features(events, games, block_rows=block_rows)
        state = with_bucket(state.withColumn("_seq", F.lit(batch_id).cast("long")), bucket_games)
        tables.upsert(features, state, live.EVENT_KEY, ["bucket"])

    return run


def refresh_coverage(table: str, games: DataFrame, counts: str, report: str, generated_at: str):
    """After a merge, recount the touched games and update the coverage rows.

    The report is built from one stored count per game, not from the event table.
    """

    def run(rows: DataFrame, batch_id: int) -> None:
        number = F.lit(batch_id).cast("long")
        fresh = coverage.events_per_game(touched_events(rows, table))
        fresh = with_bucket(fresh, SUMMARY_GAMES).withColumn("_seq", number)
        tables.upsert(counts, fresh, ["game_id"], ["bucket"])
        stored = tables.read_table(rows.sparkSession, counts, fresh.schema)
        stamp = F.lit(generated_at).cast("timestamp")
        row = coverage.collection_coverage(games, stored, stamp).withColumn("_seq", number)
        tables.upsert(report, row, ["season"], ["season"])

    return run


def new_games_only(stream: DataFrame, collected: DataFrame) -> DataFrame:
    """Drop events of games already stored before the stream started."""
    return stream.join(collected.select("game_id").distinct(), "game_id", "left_anti")


def start_ingest(
    stream: DataFrame, table: str, quarantine: str, checkpoint: str,
    bucket_games: int = BUCKET_GAMES, then: Callable | None = None,
    prepare: Callable[[DataFrame], DataFrame] | None = None, first: Callable | None = None,
) -> StreamingQuery:
    """Run over everything that has arrived, then stop."""
    step = ingest_batch(table, quarantine, bucket_games, then, prepare, first)
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def drop_late_duplicates(stream: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Suppress repeated events that arrive within ``delay``.

    Keeps the first arrival; the exact keep-last rule is the merge in ``ingest_batch``.
    """
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(live.EVENT_KEY)


def score_stream(stream: DataFrame, scorer: model.Scorer) -> DataFrame:
    """Score feature rows as they arrive."""
    return model.predict_live(stream, scorer)
