"""Ordered work per key that holds when one key owns a large share of the rows.

A window over ``partitionBy(key)`` puts all rows of a key into one task. Here the few keys that are
too large are cut into consecutive *runs* along their order column. Windows work inside a run, and a
small table with one row per run carries the state from one run to the next. Which run a row belongs
to depends only on the row and on per-key totals, so a recomputed task gives the same runs. The totals
are counted first; when no key is too large, a plain window with a single shuffle is used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portmesh.session import checkpoint

ROWS_PER_RUN = 1_000_000
# Any key beyond the 10 000 largest owns under 1/10 000 of the rows and needs no splitting.
MOST_SPLIT_KEYS = 10_000


def split_keys(df: DataFrame, keys: Sequence[str], order: str, rows_per_run: int) -> DataFrame:
    """Keys with more than ``rows_per_run`` rows and the order width of each of their runs.

    At most ``MOST_SPLIT_KEYS`` rows, so the result may be broadcast.
    """
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_lo"), F.max(order).alias("_hi")
    )
    large = totals.filter(F.col("_n") > rows_per_run)
    top = large.orderBy(F.desc("_n"), *keys).limit(MOST_SPLIT_KEYS)
    width = (F.col("_hi") - F.col("_lo")).cast("double") / F.ceil(F.col("_n") / F.lit(rows_per_run))
    return top.select(*keys, "_lo", width.alias("_width"))


def find_large(
    df: DataFrame, keys: Sequence[str], order: str, rows_per_run: int = ROWS_PER_RUN
) -> DataFrame | None:
    """The keys to split, counted now and kept, or None when every key fits into one task."""
    large = checkpoint(split_keys(df, keys, order, rows_per_run))
    return None if large.isEmpty() else F.broadcast(large)


def _in_run(order: str) -> Column:
    return F.when(
        F.col("_width") > 0, F.floor((F.col(order) - F.col("_lo")).cast("double") / F.col("_width"))
    ).otherwise(F.when(F.col("_width").isNotNull(), 0))


def with_runs(df: DataFrame, keys: Sequence[str], order: str, large: DataFrame) -> DataFrame:
    """Add ``_run``: NULL for keys left whole, else the number of the row's run along ``order``."""
    joined = df.join(large, list(keys), "left")
    return joined.withColumn("_run", _in_run(order)).drop("_lo", "_width")


def _only_split(df: DataFrame, keys: Sequence[str], order: str, large: DataFrame) -> DataFrame:
    """The rows of split keys with their run."""
    return df.join(large, list(keys)).withColumn("_run", _in_run(order)).drop("_lo", "_width")


def _carry_in(tails: DataFrame, keys: Sequence[str]) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("_tail", ignorenulls=True).over(before)
    return tails.select(*keys, "_run", carried.alias("_carry"))


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    # Runs of whole keys are NULL and never match, so those rows keep a NULL carry.
    return df.join(carry, [*keys, "_run"], "left")


def previous_in_order(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str],
    values: Sequence[str],
    alias: str = "previous",
    rows_per_run: int = ROWS_PER_RUN,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add struct ``alias`` with ``values`` of the row before in (``order``, ``ties``) per key.

    ``counted`` is a cheaper table to find the large keys in, when ``df`` is a reduction of it.
    """
    packed = F.struct(*values)
    large = find_large(df if counted is None else counted, keys, order, rows_per_run)
    if large is None:
        whole = Window.partitionBy(*keys).orderBy(order, *ties)
        return df.withColumn(alias, F.lag(packed).over(whole))
    inside = Window.partitionBy(*keys, "_run").orderBy(order, *ties)
    tails = (
        _only_split(df, keys, order, large)
        .groupBy(*keys, "_run")
        .agg(F.max_by(packed, F.struct(order, *ties)).alias("_tail"))
    )
    near = with_runs(df, keys, order, large).withColumn("_near", F.lag(packed).over(inside))
    joined = _attach(near, _carry_in(tails, keys), keys)
    return joined.withColumn(alias, F.coalesce("_near", "_carry")).drop("_near", "_carry", "_run")


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str],
    value: Column,
    alias: str,
    rows_per_run: int = ROWS_PER_RUN,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``alias``: the latest non-NULL ``value`` up to and including the row, per key."""
    valued = df.withColumn("_value", value)
    large = find_large(df if counted is None else counted, keys, order, rows_per_run)
    frame = (Window.unboundedPreceding, 0)
    latest = F.last("_value", ignorenulls=True)
    if large is None:
        whole = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(*frame)
        return valued.withColumn(alias, latest.over(whole)).drop("_value")
    upto = Window.partitionBy(*keys, "_run").orderBy(order, *ties).rowsBetween(*frame)
    rank = F.when(F.col("_value").isNotNull(), F.struct(order, *ties))
    tails = (
        _only_split(valued, keys, order, large)
        .groupBy(*keys, "_run")
        .agg(F.max_by("_value", rank).alias("_tail"))
    )
    near = with_runs(valued, keys, order, large).withColumn("_near", latest.over(upto))
    joined = _attach(near, _carry_in(tails, keys), keys)
    return joined.withColumn(alias, F.coalesce("_near", "_carry")).drop(
        "_near", "_carry", "_run", "_value"
    )


def number_rows(df: DataFrame, order: Sequence[str], alias: str = "index") -> DataFrame:
    """Dense 0-based position of every row in global ``order``, without a single-task window.

    Rows are range-partitioned and sorted once and checkpointed, because range boundaries come from
    a sample and must not be drawn twice. Each partition then needs only the number of rows before
    it: one row per partition, cumulated over that small table.
    """
    placed = checkpoint(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    sizes = placed.groupBy("_part").agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_size")
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    # One row per shuffle partition.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(alias, F.col("_offset") + F.col("_slot") - F.col("_first"))
        .drop("_part", "_slot", "_first", "_offset")
    )


def number_within(
    df: DataFrame, group: Sequence[str], order: Sequence[str], alias: str = "index"
) -> DataFrame:
    """1-based position of every row in ``order`` inside its group, safe for very large groups."""
    numbered = number_rows(df, [*group, *order], "_global")
    starts = numbered.groupBy(*group).agg(F.min("_global").alias("_start"))
    return (
        numbered.join(starts, list(group))
        .withColumn(alias, F.col("_global") - F.col("_start") + 1)
        .drop("_global", "_start")
    )
