"""Streams whose state lives in Spark's state store between batches.

* ``live_blocks``: highest score per side, last event and row count per game, day and block of event
  numbers, as a native aggregate in update mode. A batch reads its own rows only.
* ``last_arrivals``: the last row of every event by sequence, given out once no more can arrive.

The watermark bounds both states. Rows that come later than ``delay`` after the newest row are left out
here; the keyed merge of ``streaming.ingest`` takes them at any time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import live, scale
from tidemark.sources import tables
from tidemark.streaming.ingest import SUMMARY_GAMES, with_bucket

BLOCK_EVENTS = 256
BLOCK_KEY = ["game_id", "day", "block"]
BLOCKS = ("game_id string, day timestamp, block long, home double, away double, last_event double, "
          "event_rows long, _seq long, bucket long")


def live_blocks(stream: DataFrame, time_col: str, delay: str, block_events: int = BLOCK_EVENTS) -> DataFrame:
    """One row per game, day of ``time_col`` and block of event numbers, whenever it changes.

    Maxima never go back, so a late row with a lower score changes nothing. A game of any size is
    spread over its blocks.
    """
    rows = live.with_raw_scores(stream.where("game_id IS NOT NULL AND event_num IS NOT NULL"))
    return rows.withWatermark(time_col, delay).groupBy(
        "game_id", F.window(time_col, "1 day").alias("_day"),
        F.floor(F.col("event_num") / block_events).cast("long").alias("block"),
    ).agg(
        F.max("_home_raw").alias("home"), F.max("_away_raw").alias("away"),
        F.max(F.col("event_num").cast("double")).alias("last_event"), F.count(F.lit(1)).alias("event_rows"),
    ).select("game_id", F.col("_day.start").alias("day"), "block", "home", "away", "last_event", "event_rows")


def keep_blocks(table: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: the changed blocks replace their stored rows; running a batch twice is the
    same as once."""

    def run(changed: DataFrame, batch_id: int) -> None:
        rows = with_bucket(changed.withColumn("_seq", F.lit(batch_id).cast("long")), SUMMARY_GAMES).persist()
        try:
            if not rows.isEmpty():
                tables.upsert(table, rows, BLOCK_KEY, ["bucket"])
        finally:
            rows.unpersist()

    return run


def start_live_state(stream: DataFrame, table: str, checkpoint: str, time_col: str, delay: str,
                     block_events: int = BLOCK_EVENTS) -> StreamingQuery:
    """Keep the block table current over everything that has arrived, then stop."""
    return (
        live_blocks(stream, time_col, delay, block_events).writeStream.outputMode("update")
        .foreachBatch(keep_blocks(table)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def current_scores(blocks: DataFrame) -> DataFrame:
    """Score, last event and rows of every game from its blocks; no score counts as 0."""
    score = lambda c: F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0))
    rows = blocks.groupBy("game_id").agg(
        score("home").alias("home_score"), score("away").alias("away_score"),
        F.max("last_event").alias("last_event"), F.sum("event_rows").alias("event_rows"))
    return rows.withColumn("score_margin_home", F.col("home_score") - F.col("away_score"))


def last_arrivals(stream: DataFrame, time_col: str, delay: str, sequence: str = "_seq") -> DataFrame:
    """Keep-last on a stream: one row per (time, game, event), the one with the largest sequence
    number, once the watermark has passed its time.

    ``time_col`` is the time of the game or the event, the same for all its repeats. Of equal sequence
    numbers either row may stand.
    """
    rest = [c for c in stream.columns if c not in (time_col, *live.EVENT_KEY)]
    last = stream.withWatermark(time_col, delay).groupBy(time_col, *live.EVENT_KEY).agg(
        F.max_by(F.struct(*rest), F.coalesce(F.col(sequence), F.lit(-(1 << 62)))).alias("_last"))
    return last.select(time_col, *live.EVENT_KEY, "_last.*").select(*stream.columns)


# ---- coverage by signed deltas ---------------------------------------------------------------------
TOTALS = "season string, collected_games long, total_event_rows long, _seq long"
COUNTS = "game_id string, event_rows long, _seq long, bucket long"


def event_deltas(rows: DataFrame, table: str, counts: str) -> DataFrame:
    """(game_id, added, bucket, had): what a batch adds to the games it touches. New events count one,
    rows that replace a stored event count nothing: plus one for the new row, minus one for the old.
    ``bucket`` is that of the counts, a row per game, not that of the events."""
    spark = rows.sparkSession
    keys = rows.select(*live.EVENT_KEY, "bucket").distinct()
    signed = keys.select("game_id", F.lit(1).alias("sign"))
    held = tables.read_if_there(spark, table, rows.schema)
    if held is not None:
        held = held.where(tables.partitions_of(keys, ["bucket"])).select(*live.EVENT_KEY)
        replaced = keys.join(held, live.EVENT_KEY, "left_semi")
        signed = signed.unionByName(replaced.select("game_id", F.lit(-1).alias("sign")))
    added = with_bucket(signed.groupBy("game_id").agg(F.sum("sign").alias("added")), SUMMARY_GAMES)
    before = tables.read_or_empty(spark, counts, COUNTS)
    before = before.where(tables.partitions_of(with_bucket(keys.select("game_id"), SUMMARY_GAMES), ["bucket"]))
    before = before.select("game_id", F.col("event_rows").alias("had"))
    return scale.lookup_join(added, before, ["game_id"]).fillna({"had": 0})


def note_deltas(table: str, counts: str, deltas: str) -> Callable[[DataFrame, int], None]:
    """Before a merge: write down what the batch will add. A batch that runs again keeps the first
    note, which was taken before any of its rows were stored."""

    def run(rows: DataFrame, batch_id: int) -> None:
        path = f"{deltas}/batch={batch_id}"
        if tables.read_if_there(rows.sparkSession, path) is None:
            # One file, so the note is there as a whole or not at all; it has a row per touched game.
            tables.overwrite(event_deltas(rows, table, counts).coalesce(1), path)

    return run


def _add(path: str, added: DataFrame, key: str, sums: list[str], partition: str, schema: str, batch_id: int) -> None:
    """Add to stored sums; rows that already hold this batch stay as they are."""
    held = tables.read_or_empty(added.sparkSession, path, schema)
    held = held.where(tables.partitions_of(added, [partition])).select(
        key, *[F.col(c).alias(f"_{c}") for c in sums], F.col("_seq").alias("_held"))
    both = added.join(held, key, "left")
    done = F.coalesce(F.col("_held") >= batch_id, F.lit(False))
    new = {c: F.when(done, F.col(f"_{c}")).otherwise(F.coalesce(F.col(f"_{c}"), F.lit(0)) + F.col(c)) for c in sums}
    rows = both.withColumns(new).withColumn("_seq", F.lit(batch_id).cast("long")).select(*added.columns, "_seq")
    tables.upsert(path, scale.stored(rows), [key], [partition])


def apply_deltas(deltas: str, games: DataFrame, counts: str, totals: str) -> Callable[[DataFrame, int], None]:
    """After a merge: add the noted deltas to the counts per game and the totals per season. Only the
    touched buckets and seasons are read and written."""

    def run(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        noted = tables.read_table(spark, f"{deltas}/batch={batch_id}")
        _add(counts, noted.select("game_id", "bucket", F.col("added").alias("event_rows")), "game_id", ["event_rows"], "bucket",
             COUNTS, batch_id)
        seasons = scale.lookup_join(games.select("game_id", "season").distinct(), noted, ["game_id"], how="inner")
        added = seasons.groupBy("season").agg(
            F.count_if((F.col("had") == 0) & (F.col("added") > 0)).alias("collected_games"),
            F.sum("added").alias("total_event_rows"))
        if not added.isEmpty():
            _add(totals, added, "season", ["collected_games", "total_event_rows"], "season", TOTALS, batch_id)

    return run
