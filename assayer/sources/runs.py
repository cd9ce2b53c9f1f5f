"""Results of earlier runs, read for comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.results import unpivot_metrics
from assayer.sources.files import plain_path

# Metric values stay variants, because a result may hold texts or lists among its numbers.
_RUN = "model string, task string, metrics map<string, variant>, num_examples long"

SUMMARY_FILE = "summary.json"


def _entries(content: Column) -> Column:
    """The results in a file: its list ``runs``, or one result on each line. Anything else is an error."""
    listed = F.from_json(content, f"runs array<struct<{_RUN}>>")["runs"]
    rows = F.filter(F.split(content, "\n"), lambda line: F.trim(line) != "")
    lines = F.transform(rows, lambda line: F.from_json(line, _RUN))
    foreign = F.exists(lines, lambda r: r.isNull() | r["model"].isNull() | r["task"].isNull())
    message = F.concat(F.lit("Neither a list of runs nor a result on each line: "), F.col("_metadata.file_path"))
    failed = F.raise_error(message).cast(f"array<struct<{_RUN}>>")
    return F.when(listed.isNotNull(), listed).when(foreign, failed).otherwise(lines)


def read_run_results(
    spark: SparkSession, run_dirs: Sequence[str], prefer_summary: bool = True
) -> DataFrame:
    """The results under run folders: ``run_id, model, task, metrics, num_examples``.

    A run folder holds ``summary.json`` and ``<model>/<task>.json``, each with a list
    ``runs``; a summary may also be a folder of part files. Stored results, one on each line
    in folders ``run_id=…/model_key=…/task_key=…``, are read as well; JSON that is neither is
    an error. A run with a summary is read from it, any other from its task files. All runs
    are read in one scan, whatever their number; a file holds the results of one run and
    task, or one summary.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .text(list(run_dirs), wholetext=True)
        .select(_entries(F.col("value")).alias("runs"), F.split(plain_path(F.col("_metadata.file_path")), "/").alias("_path"))
    )

    def from_end(n: int):
        return F.element_at("_path", -n)

    # Stored rows name the run in a folder above those of model and task.
    named = F.filter("_path", lambda part: F.startswith(part, F.lit("run_id=")))
    run_folder = (
        F.when(F.size(named) > 0, F.element_at(named, -1))
        .when(from_end(1) == SUMMARY_FILE, from_end(2))
        .when(from_end(2) == SUMMARY_FILE, from_end(3))
        .otherwise(from_end(3))
    )
    files = files.select(
        "runs",
        ((from_end(1) == SUMMARY_FILE) | (from_end(2) == SUMMARY_FILE)).alias("_summary"),
        F.regexp_replace(run_folder, "^run_id=", "").alias("run_id"),
    )
    tasks = files.where(~F.col("_summary"))
    if prefer_summary:
        summaries = files.where("_summary")
        tasks = tasks.join(summaries.select("run_id"), "run_id", "left_anti")
        tasks = summaries.unionByName(tasks)
    entries = tasks.select("run_id", F.explode("runs").alias("_run")).where(F.col("_run").isNotNull())
    return entries.select("run_id", "_run.*")


def read_run_frame(
    spark: SparkSession, run_dirs: Sequence[str], prefer_summary: bool = True
) -> DataFrame:
    """The numeric metrics under run folders, one row each."""
    return unpivot_metrics(read_run_results(spark, run_dirs, prefer_summary))
