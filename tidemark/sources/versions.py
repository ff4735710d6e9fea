"""Tables whose partitions change version by version, so that a lost commit changes nothing.

Every batch writes the partitions it touches under a version of its own and then, as its last step,
appends one small file of pointers (partition, version). Readers take each partition's newest pointed
version. A batch that ends anywhere before the pointer file appears leaves the table as it was; its
data is never pointed to and the batch is simply run again.

Partitions are no folders: the files of a version hold ranges of partitions in order, as many files as
its size asks for, so a table may have any number of small partitions.

One writer at a time; readers may run beside it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators import reconcile
from tidemark.sources import tables

NUMBER, VERSION = "_number", "_version"


def _pointers(spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str]) -> DataFrame | None:
    kinds = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in partition_by)
    return tables.read_if_there(spark, f"{path}/pointers", f"{kinds}, {NUMBER} long, {VERSION} string")


def _same(partition_by: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in partition_by])


def current(spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str]) -> DataFrame | None:
    """(partition, version) of every partition's newest pointer; None for a new table."""
    found = _pointers(spark, path, schema, partition_by)
    if found is None:
        return None
    newest = found.groupBy(*partition_by).agg(F.max(F.struct(NUMBER, VERSION)).alias("_p"))
    return newest.select(*partition_by, f"_p.{VERSION}")


def read(spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str],
         only: DataFrame | None = None) -> DataFrame | None:
    """The table as the newest pointers show it, or just the partitions in ``only``.

    With ``only``, folders of versions that no wanted partition points to are not read, and of the
    others only the row groups between the smallest and the largest wanted partition.
    """
    newest = current(spark, path, schema, partition_by)
    if newest is None:
        return None
    if only is not None:
        wanted = only.select(*[F.col(c).alias(f"_of_{c}") for c in partition_by]).distinct()
        newest = newest.join(wanted, _same(partition_by), "left_semi")
    stored = StructType([*schema.fields]).add(VERSION, "string")
    rows = spark.read.schema(stored).parquet(f"{path}/data")
    if only is not None:
        rows = rows.where(_near(newest, partition_by))
    newest = newest.withColumnsRenamed({c: f"_of_{c}" for c in partition_by}).withColumnRenamed(VERSION, "_at")
    return rows.join(newest, (F.col(VERSION) == F.col("_at")) & _same(partition_by), "left_semi").select(*schema.names)


def _near(newest: DataFrame, partition_by: Sequence[str]) -> Column:
    """Filter for the versions in use and the ranges their partitions lie in, as literals the scan can
    prune with; rows without a partition value pass."""
    ends = [f(c).alias(f"_{k}_{c}") for c in partition_by for k, f in (("low", F.min), ("high", F.max))]
    found = newest.agg(F.collect_set(VERSION).alias(VERSION), *ends).head()
    keep = F.col(VERSION).isin(found[VERSION])
    for c in partition_by:
        keep = keep & (F.col(c).isNull() | F.col(c).between(F.lit(found[f"_low_{c}"]), F.lit(found[f"_high_{c}"])))
    return keep


def _write(rows: DataFrame, path: str, order: Sequence[str], version: str) -> None:
    tables.write_sorted(rows, f"{path}/data/{VERSION}={version}", order)


def _point(touched: DataFrame, path: str, version: str) -> None:
    """The one step that makes a batch count: a single file of a row per touched partition."""
    spark = touched.sparkSession
    names = [f.name for f in touched.schema]
    held = _pointers(spark, path, touched.schema, names)
    last = -1 if held is None else held.agg(F.max(NUMBER)).head()[0]
    rows = touched.withColumns({NUMBER: F.lit(last + 1).cast("long"), VERSION: F.lit(version)})
    rows.coalesce(1).write.mode("append").parquet(f"{path}/pointers")


def upsert(path: str, incoming: DataFrame, keys: Sequence[str], partition_by: Sequence[str],
           sequence: str = "_seq", point: Callable[[DataFrame, str, str], None] = _point) -> None:
    """Merge rows by key like ``tables.upsert``, but all at once: the table is the old one until the
    pointers are written, the new one after. A key must belong to one partition."""
    spark = incoming.sparkSession
    touched = incoming.select(*partition_by).distinct()
    existing = read(spark, path, incoming.schema, partition_by, touched)
    merged = reconcile.merge_latest(existing, incoming, keys, sequence)
    version = uuid.uuid4().hex
    _write(merged.select(*incoming.columns), path, [*partition_by, *keys], version)
    point(touched, path, version)
