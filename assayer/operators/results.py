"""Assembling run results and the tables that compare them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.reasoning import Delimiters, split_reasoning
from assayer.functions.text import fixed
from assayer.operators.positions import first_k

FRAME = ("run_id", "model", "task", "metric_name", "metric_value", "num_examples")

# The types of a JSON value that count as a number; booleans count as 0 and 1.
_NUMERIC = r"BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\)"


def prediction_samples(scored: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` predictions of every model and task, as an array in index order."""
    kept = first_k(scored.select("model", "task", "idx", "prediction"), ("model", "task"), "idx", k)
    entries = F.sort_array(F.collect_list(F.struct("idx", "prediction")))
    return kept.groupBy("model", "task").agg(
        F.transform(entries, lambda e: e["prediction"]).alias("prediction_samples")
    )


def run_results(scored: DataFrame, metrics: DataFrame | None, samples: int = 5, adapter: str = "generic") -> DataFrame:
    """One row per model and task: adapter, metrics map, example count, first predictions."""
    counts = scored.groupBy("model", "task").agg(F.count("*").alias("num_examples"))
    if metrics is None:
        result = counts.withColumn("metrics", F.create_map().cast("map<string,double>"))
    else:
        # A task has a handful of metrics; of a name given twice the later value stays.
        order = F.col("metric_order") if "metric_order" in metrics.columns else F.lit(0)
        latest = metrics.groupBy("model", "task", "metric_name").agg(
            F.max_by("metric_value", order).alias("metric_value")
        )
        entries = F.sort_array(F.collect_list(F.struct("metric_name", "metric_value")))
        maps = latest.groupBy("model", "task").agg(F.map_from_entries(entries).alias("metrics"))
        result = counts.join(maps, ["model", "task"], "left")
    return result.join(prediction_samples(scored, samples), ["model", "task"], "left").select(
        "model", "task", F.lit(adapter).alias("task_adapter"), "metrics", "num_examples", "prediction_samples"
    )


def detail_rows(scored: DataFrame, delimiters: Delimiters | None = None, limit: int | None = 50) -> DataFrame:
    """Per-example records of the first ``limit`` examples of every model and task.

    ``scored`` needs ``model, task, idx, prompt, completion, prediction_raw,
    prediction_parsed, prediction, actual_raw, actual``; ``extra`` is optional.
    """
    kept = scored if limit is None else first_k(scored, ("model", "task"), "idx", limit)
    parts = split_reasoning(F.col("completion"), delimiters) if delimiters else None
    nothing = F.lit(None).cast("string")
    extra = F.col("extra") if "extra" in scored.columns else F.create_map().cast("map<string,string>")
    return kept.select(
        "model",
        "task",
        F.col("idx").alias("index"),
        "prompt",
        "prediction_raw",
        "prediction_parsed",
        "prediction",
        F.col("prediction_raw").alias("prediction_with_prompt"),
        (parts.getField("thinking") if delimiters else nothing).alias("prediction_thinking"),
        (parts.getField("answer") if delimiters else nothing).alias("prediction_answer"),
        "actual_raw",
        "actual",
        extra.alias("extra"),
    )


def unpivot_metrics(results: DataFrame) -> DataFrame:
    """One row per numeric metric of every result; other values and NULL maps give none.

    The map may hold doubles, or variants as read from JSON.
    """
    rows = results.select(
        "run_id", "model", "task", F.explode("metrics").alias("metric_name", "_value"), "num_examples"
    )
    value = F.col("_value")
    if isinstance(rows.schema["_value"].dataType, T.VariantType):
        kind = F.schema_of_variant(value)
        rows = rows.where(kind.rlike(f"^({_NUMERIC})$"))
        as_flag = F.try_variant_get(value, "$", "boolean").cast("double")
        number = F.when(kind == "BOOLEAN", as_flag).otherwise(F.try_variant_get(value, "$", "double"))
    else:
        rows = rows.where(value.isNotNull())
        number = value.cast("double")
    return rows.select("run_id", "model", "task", "metric_name", number.alias("metric_value"), "num_examples")


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Result frames of several runs under one another; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def select_metrics(frame: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """The distinct metric names in order, after the include and the exclude list."""
    return frame.where(_chosen(include, exclude)).select("metric_name").distinct().orderBy("metric_name")


def only_metrics(frame: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """The rows of the metrics that :func:`select_metrics` names."""
    return frame.where(_chosen(include, exclude))


def _chosen(include: Sequence[str], exclude: Sequence[str]) -> Column:
    name = F.col("metric_name")
    chosen = name.isNotNull()
    if include:
        chosen = chosen & name.isin(list(include))
    if exclude:
        chosen = chosen & ~name.isin(list(exclude))
    return chosen


def summary(frame: DataFrame) -> DataFrame:
    """The mean of every metric over all runs."""
    return frame.groupBy("metric_name").agg(F.avg("metric_value").alias("metric_value"))


def report(frame: DataFrame) -> DataFrame:
    """The summary as lines of text, numbered from 0: a heading, then one per metric."""
    lines = summary(frame).select(
        F.col("metric_name"),
        F.concat(F.lit("- "), "metric_name", F.lit(": "), fixed(F.col("metric_value"), 4)).alias("line"),
    )
    # One entry per metric name, which the job description bounds.
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct("metric_name", "line"))), lambda e: e["line"]
    )
    heading = F.array(F.lit("Summary metrics:"))
    return lines.agg(F.concat(heading, listed).alias("_lines")).select(
        F.posexplode("_lines").alias("line_number", "line")
    )


def by_model(frame: DataFrame) -> DataFrame:
    """Mean per metric and model, across tasks."""
    return frame.groupBy("metric_name", "model").agg(F.avg("metric_value").alias("metric_value"))


def by_task(frame: DataFrame) -> DataFrame:
    """Mean and count per metric, task and model."""
    return frame.groupBy("metric_name", "task", "model").agg(
        F.avg("metric_value").alias("metric_value"), F.count("metric_value").alias("n")
    )


def heatmap(frame: DataFrame, metric: str, models: Sequence[str] | None = None) -> DataFrame:
    """Mean of one metric: a row per task, a column per model."""
    rows = frame.where(F.col("metric_name") == metric).groupBy("task")
    return rows.pivot("model", list(models) if models else None).agg(F.avg("metric_value"))


def summary_table(frame: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Mean of every metric: a row per model, a column per metric."""
    pivoted = frame.groupBy("model").pivot("metric_name", list(metrics) if metrics else None)
    return pivoted.agg(F.avg("metric_value"))


def compare_runs(frame: DataFrame) -> DataFrame:
    """Mean per metric, axis value and run: ``metric_name, axis, category, run_id``.

    The axis of a metric is the task if it has more than one, else the model. Whether
    there is more than one shows in the least and the greatest task, so no distinct count
    is needed. Both sides of the join are aggregates already; adaptive execution broadcasts
    the axes when they prove small.
    """
    axes = frame.groupBy("metric_name").agg(
        F.coalesce(F.min("task") != F.max("task"), F.lit(False)).alias("_many")
    )
    means = frame.groupBy("metric_name", "task", "model", "run_id").agg(
        F.sum("metric_value").alias("_sum"), F.count("metric_value").alias("_n")
    )
    axis = F.when(F.col("_many"), F.lit("task")).otherwise(F.lit("model"))
    category = F.when(F.col("_many"), F.col("task")).otherwise(F.col("model"))
    return (
        means.join(axes, "metric_name")
        .groupBy("metric_name", axis.alias("axis"), category.alias("category"), "run_id")
        .agg((F.sum("_sum") / F.sum("_n")).alias("metric_value"))
    )
