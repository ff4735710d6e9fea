"""Which games are already collected, as a bitmap index instead of a scan over all events.

Game ids are ten digits; those of a season follow one another, so a few bitmaps of 32,768 ids hold a
whole season. The ingest adds the ids of each batch; asking for what is left reads the bitmaps only.
Ids that are no ten-digit numbers above zero are kept by themselves, so the answer is exact for any id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import tables

INDEX = "season string, bucket long, bits binary"
OTHERS = "game_id string, shard int, _seq long"
DIGITS, SHARDS = 10, 64


def _number() -> Column:
    """The id as a number where that says everything about it."""
    number = F.col("game_id").try_cast("long")
    exact = F.lpad(number.cast("string"), DIGITS, "0") == F.col("game_id")
    return F.when(exact & (number > 0), number)


def bitmaps(rows: DataFrame) -> DataFrame:
    """(season, bucket, bits) of the ids that are numbers; combined on the map side."""
    ids = rows.select(F.coalesce("season", F.lit("")).alias("season"), _number().alias("id")).where("id IS NOT NULL")
    return ids.groupBy("season", F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def add(path: str, rows: DataFrame) -> None:
    """Add the games of ``rows`` (season, game_id). Adding them again changes nothing."""
    spark = rows.sparkSession
    fresh = bitmaps(rows)
    held = tables.read_if_there(spark, f"{path}/bitmaps", INDEX)
    if held is not None:
        fresh = fresh.unionByName(held.where(tables.partitions_of(fresh, ["season"])))
    merged = fresh.groupBy("season", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season").parquet(f"{path}/bitmaps")
    others = rows.where(F.col("game_id").isNotNull() & _number().isNull()).select("game_id").distinct()
    others = others.select("game_id", F.pmod(F.hash("game_id"), F.lit(SHARDS)).alias("shard"), F.lit(0).cast("long").alias("_seq"))
    if not others.isEmpty():
        tables.upsert(f"{path}/others", others, ["game_id"], ["shard"])


def left_to_collect(games: DataFrame, path: str) -> DataFrame:
    """Games whose id is not in the index; games without an id are left as well."""
    spark: SparkSession = games.sparkSession
    index = tables.read_or_empty(spark, f"{path}/bitmaps", INDEX)
    index = index.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("_bits"))
    rows = games.withColumn("_id", _number())
    rows = rows.withColumn("bucket", F.bitmap_bucket_number("_id")).join(index, "bucket", "left")
    place = F.bitmap_bit_position("_id")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    seen = F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1
    rows = rows.where(~F.coalesce(seen, F.lit(False))).drop("_id", "_bits", "bucket")
    others = tables.read_or_empty(spark, f"{path}/others", OTHERS).select("game_id")
    return rows.join(others, "game_id", "left_anti").select(*games.columns)
