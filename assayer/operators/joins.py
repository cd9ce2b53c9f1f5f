"""Pairing examples with models, predictions and references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.session import materialize

# Rows of one key that a single task should meet.
HOT_ROWS = 100_000

# Keys (12 bytes each) that are split at most.
HOT_KEYS = 100_000


def for_each_model(examples: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every example once per model of the job, in the order the models are listed.

    The list comes from the job description, so this is a projection, not a join.
    """
    listed = F.array(*(F.lit(m) for m in models))
    return examples.select(F.posexplode(listed).alias("model_order", "model"), "*")


def with_references(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Attach ``reference`` by ``(task, idx)``; a prediction without one keeps NULL."""
    return predictions.join(references.select("task", "idx", "reference"), ["task", "idx"], "left")


def join_spread(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Left join on ``key`` where some keys may hold a large share of the left rows.

    Keys with more than ``hot_rows`` left rows are split by ``spread_by`` into parts of
    about that size, and their right rows (one per key) are repeated once per part. With
    very many left rows the limit rises, so that never more than ``HOT_KEYS`` keys are hot
    and their list can go to every task. ``left`` is read several times, so it should be
    stored.
    """
    rows = left.count()
    if rows <= hot_rows:
        return left.join(right, key, "left")
    hot_rows = max(hot_rows, -(-rows // HOT_KEYS))
    hot = (
        left.groupBy(key)
        .count()
        .where(F.col("count") > hot_rows)
        .select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts"))
    )
    hot = F.broadcast(materialize(hot, "hot-keys"))
    part = F.pmod(F.xxhash64(spread_by), F.coalesce("_parts", F.lit(1))).cast("int")
    every_part = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    split = left.join(hot, key, "left").withColumn("_part", part).drop("_parts")
    repeated = right.join(hot, key, "left").withColumn("_part", F.explode(every_part)).drop("_parts")
    return split.join(repeated, [key, "_part"], "left").drop("_part")
