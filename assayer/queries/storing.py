"""Sinks, each written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.results import unpivot_metrics
from assayer.queries.registry import (
    CUSTOMERS,
    FRAME,
    customers,
    past_results,
    query,
    rounded,
    table,
)
from assayer.session import materialize, new_path
from assayer.sinks.writers import save, save_by_run, save_checkpoints

_SCHEMA = "run_id string, model string, task string, metrics map<string,double>, num_examples long"
_MEANS = f"""SELECT run_id, model, task, metric_name, round(avg(metric_value), 6) AS metric_value, count(*) AS n
    FROM {FRAME} GROUP BY ALL"""


def _means(stored: DataFrame) -> DataFrame:
    return unpivot_metrics(stored).groupBy("run_id", "model", "task", "metric_name").agg(
        rounded(F.avg("metric_value")).alias("metric_value"), F.count("*").alias("n")
    )


@query("sink_json_roundtrip", _MEANS)
def sink_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per run, model and task."""
    path = new_path(spark, "json")
    save(past_results(spark, sf_dir), path, "json")
    stored = spark.read.schema(f"{_SCHEMA}, model_key string, task_key string").json(path)
    return _means(stored)


@query("sink_jsonl_roundtrip", _MEANS)
def sink_jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "jsonl")
    save(past_results(spark, sf_dir), path, "jsonl")
    return _means(spark.read.schema(_SCHEMA).json(path))


@query(
    "sink_csv_roundtrip",
    """SELECT doc_id, text, CAST(quality AS VARCHAR) AS quality, '["' || lang || '"]' AS tags
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def sink_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks and quotes inside texts, missing values, and a nested column."""
    path = new_path(spark, "csv")
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    save(documents.select("text", "doc_id", F.array("lang").alias("tags"), "quality"), path, "csv")
    stored = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return stored.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "quality", "tags")


@query(
    "checkpoint_groups",
    f"""SELECT c_custkey // 24 + 1 AS flush_group, count(*) AS n, min(c_custkey) AS first_idx, max(c_custkey) AS last_idx,
        CAST(sum(length(output)) AS BIGINT) AS chars
    FROM {CUSTOMERS} GROUP BY ALL""",
)
def checkpoint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions flushed every three batches of eight, counted after reading them back."""
    path = new_path(spark, "checkpoints")
    predictions = customers(spark, sf_dir).select(F.col("c_custkey").alias("idx"), "output")
    stored = save_checkpoints(predictions, path, batch_size=8, every_batches=3, parts=5)
    return stored.groupBy("flush_group").agg(
        F.count("*").alias("n"),
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.sum(F.length("output")).alias("chars"),
    )


@query(
    "checkpoint_resume",
    f"""SELECT c_custkey // 12 + 1 AS flush_group, count(*) AS n, count(DISTINCT c_custkey) AS examples, min(c_custkey) AS first_idx,
        max(c_custkey) AS last_idx, CAST(sum(length(output)) AS BIGINT) AS chars
    FROM {CUSTOMERS} GROUP BY ALL""",
)
def checkpoint_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job over two thirds of the rows, then one over all of them with other batches, then once more."""
    path = new_path(spark, "checkpoints")
    predictions = materialize(customers(spark, sf_dir).select(F.col("c_custkey").alias("idx"), "output"), "predictions")
    last = predictions.agg(F.max("idx")).first()[0]
    save_checkpoints(predictions.where(F.col("idx") <= last * 2 // 3), path, batch_size=8, every_batches=3, parts=3)
    for _ in range(2):
        stored = save_checkpoints(predictions, path, batch_size=6, every_batches=2, parts=2)
    return stored.groupBy("flush_group").agg(
        F.count("*").alias("n"),
        F.countDistinct("idx").alias("examples"),
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.sum(F.length("output")).alias("chars"),
    )


@query("sink_json_replaced", _MEANS)
def sink_json_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a run that is repeated take the place of the former ones; the other runs stay."""
    path = new_path(spark, "json")
    results = past_results(spark, sf_dir)
    some = results.where(F.crc32("task") % 2 == 0)
    save_by_run(results, path)
    save_by_run(some.withColumn("metrics", F.transform_values("metrics", lambda k, v: v + 1)), path, mode="replace")
    save_by_run(some, path, mode="replace")
    return _means(spark.read.schema(f"{_SCHEMA}, model_key string, task_key string").json(path))
