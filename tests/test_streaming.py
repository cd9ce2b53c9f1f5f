from pathlib import Path

from pyspark.sql import functions as F

from assayer.queries import all_queries, streams
from assayer.streaming.checkpoints import run_checkpointed
from assayer.streaming.leaderboard import read_leaderboard, read_results, run_leaderboard


def result(spark, model, value):
    metrics = F.create_map(F.lit("acc"), F.lit(value))
    return spark.range(1).select(F.lit("r").alias("run_id"), F.lit(model).alias("model"), F.lit("t").alias("task"), metrics.alias("metrics"))


def test_leaderboard_goes_on_with_new_results(spark, tmp_path):
    arrived, board, progress = (str(tmp_path / n) for n in ("in", "board", "progress"))

    def follow():
        run_leaderboard(read_results(spark, arrived, 1), board, progress).awaitTermination()
        return {r.model: (r.metric_value, r.n_results) for r in read_leaderboard(spark, board).collect()}

    result(spark, "a", 1.0).write.json(arrived)
    result(spark, "b", 0.5).write.mode("append").json(arrived)
    assert follow() == {"a": (1.0, 1), "b": (0.5, 1)}
    result(spark, "a", 0.0).write.mode("append").json(arrived)
    assert follow() == {"a": (0.5, 2), "b": (0.5, 1)}


def test_checkpointed_scoring_restarts_without_duplicates(spark, tmp_path):
    arrived, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(arrived)
    score = lambda batch: batch.withColumn("twice", F.col("id") * 2)
    spark.range(10).repartition(3).write.parquet(arrived)
    run_checkpointed(stream(), score, table, progress).awaitTermination()
    run_checkpointed(stream(), score, table, progress).awaitTermination()
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(arrived)
    run_checkpointed(stream(), score, table, progress).awaitTermination()
    assert sorted(r.twice for r in spark.read.parquet(table).collect()) == [2 * i for i in range(12)]


def test_batches_do_not_follow_the_tasks_that_read(spark, small, tmp_path, monkeypatch):
    """Orders in many files: each run's results still arrive in one."""
    spark.read.parquet(f"{small}/orders.parquet").repartition(8).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(streams, "new_path", lambda spark, purpose: f"{tmp_path}/{purpose}")
    found = all_queries()["stream_leaderboard"](spark, str(tmp_path))
    runs = list(Path(tmp_path, "arrived").glob("run_id=*"))
    assert len(list(Path(tmp_path, "arrived").glob("run_id=*/part-*"))) == len(runs) > 3
    assert len(list(Path(tmp_path, "board").glob("batch_id=*"))) == -(-len(runs) // 3)
    counts = spark.read.parquet(f"{small}/orders.parquet").groupBy(F.col("o_orderpriority").alias("model")).count()
    assert {(r.model, r.n_results) for r in found.collect()} == {(r.model, r["count"]) for r in counts.collect()}
