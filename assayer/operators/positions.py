"""Row positions without a single-task sort, and batch numbers derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.session import broadcast_if_small, materialize

# TakeOrderedAndProject merges its rows on the driver, so larger heads go by position.
_DRIVER_HEAD = 100_000


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_position(
    df: DataFrame,
    order: Sequence[str],
    within: Sequence[str] = (),
    name: str = "idx",
    start: int = 0,
) -> DataFrame:
    """Number the rows in the order of ``order``, anew inside each ``within`` group.

    Rows are range-partitioned on group and order, so a group of any size spreads over
    many tasks. Each task numbers its own rows; a table with one line per task and group
    then shifts them. ``order`` must be unique inside a group. Columns of any name stay as they are.
    """
    if name in df.columns:
        raise ValueError(f"There is a column '{name}' already")
    keys = [*within, *order]
    laid_out = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    part = unused("_part", df)
    return number_in_place(laid_out.withColumn(part, F.spark_partition_id()), part, within, name, start)


def with_file_position(
    df: DataFrame, file: str, split: str, row: str, name: str = "idx", start: int = 0
) -> DataFrame:
    """Number rows that are read from files, in the order of ``file`` and ``row`` in it.

    The rows stay in the tasks that read them, so nothing is shuffled: every split of a file
    is in order, and a table with one line per split shifts the numbers. ``df`` must not have
    been shuffled since it was read; rows may have been filtered out.
    """
    place = F.struct(F.col(file).alias("file"), F.col(split).alias("split"))
    part = unused("_part", df)
    return number_in_place(df.withColumn(part, place), part, (), name, start)


def number_in_place(
    df: DataFrame, part: str, within: Sequence[str], name: str, start: int
) -> DataFrame:
    """Number rows that already lie in order inside each value of ``part``."""
    row = unused("_row", df)
    laid_out = materialize(df.withColumn(row, F.monotonically_increasing_id()), "positions")
    keys = [part, *within]
    # The small tables have names of their own, whatever the columns of ``df`` are called.
    named = [F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]
    stretches = laid_out.groupBy(*named).agg(F.min(row).alias("first"), F.count("*").alias("rows"))
    before = (
        Window.partitionBy(*([f"key_{i}" for i in range(1, len(keys))] or [F.lit(0)]))
        .orderBy("key_0")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = F.coalesce(F.sum("rows").over(before), F.lit(0))
    shift, taken = unused("_shift", laid_out), [unused(f"_key_{i}", laid_out) for i in range(len(keys))]
    stretches = materialize(
        stretches.select(*(F.col(f"key_{i}").alias(k) for i, k in enumerate(taken)), (offset - F.col("first") + start).alias(shift)),
        "offsets",
    )
    same = [F.col(k).eqNullSafe(F.col(own)) for k, own in zip(keys, taken)]
    joined = laid_out.join(broadcast_if_small(stretches, 500_000), same)
    kept = [c for c in df.columns if c != part]
    return joined.select(*kept, (F.col(row) + F.col(shift)).alias(name))


def head(df: DataFrame, order: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` rows in the order of ``order``; all of them without ``n``."""
    if not n:
        return df
    if n <= _DRIVER_HEAD:
        return df.orderBy(*order).limit(n)
    position = unused("_position", df)
    return with_position(df, order, name=position).where(F.col(position) < n).drop(position)


def first_k(df: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """The first ``k`` rows of every group; each task drops the rest before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    place = unused("_rank", df)
    return df.withColumn(place, rank).where(F.col(place) <= k).drop(place)


def batch_ledger(
    examples: DataFrame,
    keys: Sequence[str],
    idx: str = "idx",
    batch_size: int | None = None,
    max_batch_size: int | None = None,
) -> DataFrame:
    """One row per batch: its number, the total, and the positions it covers.

    Positions must run from 0 without gaps. Rows are counted per batch first, so a group
    that holds most examples is reduced before it is shuffled. Without any batch size the
    whole group is one batch.
    """
    size = batch_size or max_batch_size
    batch = (F.floor(F.col(idx) / size) + 1).cast("long") if size else F.lit(1).cast("long")
    batches = (
        examples.groupBy(*keys, batch.alias("batch"))
        .agg(F.count("*").alias("rows"), F.min(idx).alias("first_idx"))
    )
    totals = batches.groupBy(*keys).agg(F.max("batch").alias("total_batches"))
    return batches.join(totals, list(keys))


def progress_rows(ledger: DataFrame, every: int = 1) -> DataFrame:
    """The ledger rows a progress report shows: every n-th batch and the last."""
    every = max(every, 1)
    return ledger.where(
        (F.col("batch") % every == 0) | (F.col("batch") == F.col("total_batches"))
    )


def flush_group(idx, batch_size: int, every_batches: int):
    """The checkpoint flush that an example belongs to, counted from 1."""
    return (F.floor(idx / (batch_size * every_batches)) + 1).cast("long")
