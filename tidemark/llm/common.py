"""Helpers that several corpus operators share: stored tables, splits, and connected components."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scale import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(name: str) -> None:
    """Send a module's functions to the workers with their code, so executors need no copy of this
    package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the folder the cluster names in spark.checkpoint.dir."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: it cuts the lineage, survives lost
    executors, and every later reader sees the same rows."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def look_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of many rows per key with one row per key.

    The table usually comes from a sum per key and lies by that key already. Joining on a hash of it
    as well makes Spark deal out both sides, and then it can split the partitions of frequent keys at
    run time, which it cannot do where one side stays as it lies.
    """
    code = F.xxhash64(key).alias("_code")
    return rows.select("*", code).join(table.select("*", code), [key, "_code"]).drop("_code")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def _digest(pairs: DataFrame) -> tuple:
    """Row count, sum and xor of row hashes: alike for equal sets of pairs only, but for one chance
    in 2^128."""
    code = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(code.cast("decimal(20,0)")), F.bit_xor(code)).head())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected ``edges`` (a, b); component is the
    smallest node reachable.

    Alternates two star steps until nothing changes: every node hands the smallest node it knows to
    its larger neighbours, then to its smaller ones. Nodes with many edges only need a minimum,
    which is combined on the map side. An empty table gives an empty table.
    """
    pairs = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, "links")
    before = _digest(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = look_up(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = look_up(larger, least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        pairs = stored(smaller.select("p.u", "p.v").where("u <> v").distinct(), "links")
        after = _digest(pairs)
        if after == before:
            break
        before = after
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(roots)
