"""A leaderboard that follows results while jobs still write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.operators.results import unpivot_metrics

# What a job writes per model and task, one JSON object per line.
RESULT_LINE = "run_id string, model string, task string, metrics map<string,double>, num_examples long"


def read_results(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Result lines as a stream, in the order their files appear."""
    reader = spark.readStream.schema(RESULT_LINE).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).select("*", F.col("_metadata.file_modification_time").alias("stored_at"))


def latest_results(results: DataFrame) -> DataFrame:
    """The value of every metric of a run and task that was stored last; the state is one row for each."""
    values = results.select("run_id", "model", "task", "stored_at", F.explode("metrics").alias("metric_name", "metric_value"))
    newest = F.max_by("metric_value", "stored_at").alias("metric_value")
    return values.where("metric_value IS NOT NULL").groupBy("run_id", "model", "task", "metric_name").agg(newest)


def _board(values: DataFrame) -> DataFrame:
    return values.groupBy("metric_name", "model").agg(F.avg("metric_value").alias("metric_value"), F.count("*").alias("n_results"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Running mean and count per metric and model; the state is one row for each."""
    return _board(unpivot_metrics(results))


def run_leaderboard(results: DataFrame, table: str, checkpoint: str, replaced: bool = False) -> StreamingQuery:
    """Keep ``table`` (a folder) at the latest leaderboard, through all results now present.

    Every batch writes its own ``batch_id`` folder, so a batch that is run again after a
    failure replaces itself. If results can be ``replaced``, one that is stored again takes the
    place of the former one of its run, model and task; otherwise every line counts.
    """

    def write(latest: DataFrame, batch_id: int) -> None:
        board = _board(latest) if replaced else latest
        board.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        (latest_results(results) if replaced else leaderboard(results))
        .writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_leaderboard(spark: SparkSession, table: str) -> DataFrame:
    """The leaderboard as of the last batch."""
    boards = spark.read.parquet(table)
    last = boards.agg(F.max("batch_id").alias("last")).first()["last"]
    return boards.where(F.col("batch_id") == last).drop("batch_id")
