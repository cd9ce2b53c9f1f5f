"""Structured Streaming forms, each run to the end of what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.choices import postprocess
from assayer.functions.reasoning import Delimiters
from assayer.queries.registry import (
    CUSTOMERS,
    FRAME,
    SEGMENTS,
    customers,
    past_results,
    query,
    rounded,
    sql_choice,
    sql_strip,
    sql_thinking,
)
from assayer.session import new_path
from assayer.streaming.checkpoints import run_checkpointed
from assayer.streaming.leaderboard import read_leaderboard, read_results, run_leaderboard


@query(
    "stream_leaderboard",
    f"SELECT metric_name, model, round(avg(metric_value), 6) AS metric_value, count(*) AS n_results FROM {FRAME} GROUP BY ALL",
)
def stream_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results arrive run by run; the board follows them over several batches."""
    arrived, board = new_path(spark, "arrived"), new_path(spark, "board")
    # A run's results lie together, so files, and with them batches, follow the size of the data, not the tasks that read it.
    past_results(spark, sf_dir).hint("rebalance", "run_id").write.partitionBy("run_id").json(arrived)
    results = read_results(spark, arrived, files_per_trigger=3)
    run_leaderboard(results, board, new_path(spark, "progress")).awaitTermination()
    return read_leaderboard(spark, board).withColumn("metric_value", rounded("metric_value"))


@query(
    "stream_checkpoint",
    f"""WITH parts AS (SELECT c_custkey, output, {sql_thinking('output')} FROM {CUSTOMERS}),
    answers AS (SELECT c_custkey, {sql_strip('CASE WHEN marked THEN after ELSE output END')} AS answer FROM parts)
    SELECT c_custkey AS idx, {sql_choice('answer', SEGMENTS[0])} AS prediction FROM answers""",
)
def stream_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions are scored batch by batch into a table that survives a restart."""
    arrived, scored = new_path(spark, "completions"), new_path(spark, "scored")
    completions = customers(spark, sf_dir).select(F.col("c_custkey").alias("idx"), "output", "c_nationkey")
    completions.write.partitionBy("c_nationkey").parquet(arrived)
    stream = (
        spark.readStream.schema("idx long, output string, c_nationkey int")
        .option("maxFilesPerTrigger", 10)
        .parquet(arrived)
    )
    think = Delimiters("<think>", "</think>", strip_from_prediction=True)

    def score(batch: DataFrame) -> DataFrame:
        return batch.select("idx", postprocess(F.col("output"), SEGMENTS, None, think).alias("prediction"))

    run_checkpointed(stream, score, scored, new_path(spark, "progress")).awaitTermination()
    return spark.read.parquet(scored).select("idx", "prediction")
