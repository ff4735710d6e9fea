"""Building blocks that keep ordered and keyed work spread out when one key is huge.

* ``keep_last`` / ``top_per_key``: rank filters Spark can cut before the shuffle.
* ``block_*``: ordered per-key work done in blocks of rows; only one summary row per block is
  walked per key, so a key with a third of all rows still uses many tasks.
* ``lookup_join``: many rows against one row per key.
* ``ordered_layout`` and friends: positions and running totals in one total order without a
  window over the whole table in a single task.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, SLOT = "_block", "_slot"
DEFAULT_BLOCK_ROWS = 1 << 18


# ---- rank filters -------------------------------------------------------------------
def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key in the given order (partial limit runs before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], *sequence: str) -> DataFrame:
    """One row per key, the one that came last in ingest order."""
    return top_per_key(df, keys, [F.col(c).desc_nulls_last() for c in sequence], 1)


def keep_first(df: DataFrame, keys: Sequence[str], *sequence: str) -> DataFrame:
    return top_per_key(df, keys, [F.col(c).asc_nulls_last() for c in sequence], 1)


# ---- block-wise ordered work -----------------------------------------------------------
def with_block(
    df: DataFrame, keys: Sequence[str], order: str, tie: Sequence[str] = (),
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Rows stored once in the order of keys, ``order`` and ``tie``, cut into blocks by row count.

    ``SLOT`` is the place in that order; a block has at most ``block_rows`` rows whatever the
    numbers in ``order`` are, and blocks of a key are numbered in order. Rows without a key come
    first, rows without an order value last within their key. Storing fixes which row sits where.
    """
    sort = [
        *[F.col(k).asc_nulls_first() for k in keys],
        *[F.col(c).asc_nulls_last() for c in (order, *tie)],
    ]
    laid = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    laid = stored(laid.withColumn(SLOT, F.monotonically_increasing_id()))
    part = F.shiftright(SLOT, 33)
    local = F.floor(F.col(SLOT).bitwiseAND(F.lit((1 << 33) - 1)) / block_rows)
    return laid.withColumn(BLOCK, F.shiftleft(part, 33) + local)


def block_summary(df: DataFrame, keys: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """One row per key and block; the map side combines before anything is shuffled."""
    return df.groupBy(*keys, BLOCK).agg(*[c.alias(n) for n, c in aggs.items()])


def join_blocks(rows: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put the columns of a block table onto the rows; rows without a key find theirs too."""
    by = [*keys, BLOCK]
    named = blocks.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return rows.join(named, same).drop(*[f"_by_{c}" for c in by])


def blocks_before(keys: Sequence[str]):
    """All earlier blocks of the same key."""
    w = Window.partitionBy(*keys).orderBy(BLOCK)
    return w.rowsBetween(Window.unboundedPreceding, -1)


def all_blocks(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def inside_block(keys: Sequence[str]):
    return Window.partitionBy(*keys, BLOCK).orderBy(SLOT)


def add_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Mapping[str, str],
    tie: Sequence[str] = (),
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> DataFrame:
    """Previous row's values per key (lag), ``columns`` maps new name -> source column.

    Rows without a key are one group of their own. ``tie`` orders rows of equal ``order``.
    """
    blocked = with_block(df, keys, order, tie, block_rows)
    packed = F.struct(*[F.col(src).alias(new) for new, src in columns.items()])
    tails = block_summary(blocked, keys, {"_tail": F.max_by(packed, SLOT)})
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    tails = tails.select(*keys, BLOCK, F.lag("_tail").over(by_block).alias("_carried"))
    out = join_blocks(blocked, tails, keys)
    out = out.withColumn("_prev", F.coalesce(F.lag(packed).over(inside_block(keys)), F.col("_carried")))
    for new in columns:
        out = out.withColumn(new, F.col("_prev").getField(new))
    return out.drop("_prev", "_carried", BLOCK, SLOT)


# ---- joins against one row per key ---------------------------------------------------------
def lookup_join(facts: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join many ``facts`` rows to at most one ``dim`` row per key, the same way at every size.

    Spark sends ``dim`` to every task when it measures it below its own limit, and otherwise
    shuffles both sides by key; partitions that a frequent key makes large are then split at run
    time, and only the one ``dim`` row of that key is repeated.
    """
    return facts.join(dim, list(keys), how)


# ---- one total order -----------------------------------------------------------------------
def shared_folder(spark) -> str:
    """Folder all executors share, as the cluster names it; a local session gets its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ordered_layout(df: DataFrame, *order: str) -> DataFrame:
    """Range-partitioned, sorted and stored once, with ``_part`` and ``_slot`` in that order.

    Storing it fixes which row sits where, so counts per part and rows agree even when
    executors are lost between the two reads.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = cut_lineage(laid.withColumn("_slot", F.monotonically_increasing_id()))
    return laid.withColumn("_part", F.shiftright("_slot", 33))


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Zero-based position in the total order, plus ``total`` rows.

    The starts table has one row per partition, which bounds its window and its broadcast.
    """
    laid = ordered_layout(df, *order)
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    starts = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        F.sum("_n").over(everything).alias("total"),
    )
    local = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    out = laid.join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + local).drop("_part", "_slot", "_start")


COARSE_BITS, FINE_BITS = 12, 20


def radix_digits(value: str) -> tuple[Column, Column]:
    """Two digits that order doubles like the values themselves: exponent with the leading bits of the
    fraction, then ``FINE_BITS`` more.

    Scaling by powers of two, rounding down and subtracting are exact, so a digit only depends on the
    value and never breaks the order. At most a few thousand coarse digits occur, at most 2^20 fine
    digits within one, and at most 2^21 doubles share both. Negative values have negative digits; a
    missing value comes first and one that is no number last.
    """
    whole = F.col(value).cast("double")
    v = F.abs(F.coalesce(F.nanvl(whole, F.lit(0.0)), F.lit(0.0)))
    exponent = F.when(v == 0, F.lit(-1100.0)).otherwise(F.greatest(F.floor(F.log2(v)).cast("double"), F.lit(-1022.0)))
    fraction = F.when(v == 0, F.lit(0.0)).otherwise(v / F.pow(F.lit(2.0), exponent)) * float(1 << COARSE_BITS)
    lead = F.floor(fraction)
    fine = F.floor((fraction - lead) * float(1 << FINE_BITS))
    sign = F.when(F.col(value) < 0, -1).otherwise(1).cast("long")
    coarse = (exponent.cast("long") + 1100) * (1 << COARSE_BITS + 2) + lead
    edge = F.when(whole.isNull(), F.lit(-(1 << 62))).when(F.isnan(whole), F.lit(1 << 62))
    return F.coalesce(edge, sign * coarse), sign * fine


def with_total_before(df: DataFrame, group: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows of the group with a smaller ``order`` (a double, distinct within
    the group).

    A radix ranking: sums per coarse and fine digit are combined on the map side, running totals over
    those few rows give where each bucket starts, and rows are only compared inside their bucket. No
    range sort, nothing stored, and a group of any size is spread over its buckets.
    """
    keys, earlier = list(group), (Window.unboundedPreceding, -1)
    coarse, fine = radix_digits(order)
    rows = df.withColumns({"_coarse": coarse, "_fine": fine})
    cells = rows.groupBy(*keys, "_coarse", "_fine").agg(F.sum(value).alias("_n"))
    tops = cells.groupBy(*keys, "_coarse").agg(F.sum("_n").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("_coarse").rowsBetween(*earlier)
    tops = tops.select(*keys, "_coarse", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_coarse").orderBy("_fine").rowsBetween(*earlier)
    cells = cells.join(tops, [*keys, "_coarse"])
    cells = cells.withColumn("_start", F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    last = Window.partitionBy(*keys, "_coarse", "_fine").orderBy(order).rowsBetween(*earlier)
    out = rows.join(cells.drop("_n"), [*keys, "_coarse", "_fine"])
    total = F.col("_start") + F.coalesce(F.sum(value).over(last), F.lit(0))
    return out.withColumn(name, total).drop("_coarse", "_fine", "_start")
