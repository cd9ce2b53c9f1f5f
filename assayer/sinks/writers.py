"""Run results as JSON, JSON lines or CSV, and checkpoints of predictions."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.naming import output_key
from assayer.operators.positions import flush_group
from assayer.sinks import commits
from assayer.sinks.commits import PARTS

RUN_KEYS = ("run_id", "model", "task")


def save(results: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write results as ``json`` (a folder per run, model and task), ``jsonl`` or ``csv``."""
    kind = fmt.lower()
    if kind == "json":
        save_by_run(results, path, mode)
    elif kind == "jsonl":
        results.write.mode(mode).json(path)
    elif kind == "csv":
        save_csv(results, path, mode)
    else:
        raise ValueError(f"Unsupported format: {fmt}")


def save_by_run(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``run_id=…/model_key=…/task_key=…``, with the keys kept as columns too.

    Rows are balanced by folder before they are written; a folder that holds most of them
    is written by several tasks. With the mode ``replace`` the rows take the place of earlier
    ones of their run, model and task, and all others stay.
    """
    keyed = results.withColumns(
        {"model_key": output_key(F.col("model")), "task_key": output_key(F.col("task"))}
    )
    folders = ["run_id", "model_key", "task_key"]
    writer = keyed.hint("rebalance", *folders).write.partitionBy(*folders)
    if mode == "replace":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)
    else:
        writer.mode(mode).json(path)


def save_summary(results: DataFrame, means: DataFrame, run_id: str, path: str) -> None:
    """One JSON object for a run: its ``runs``, the mean per metric, its id; a former one is replaced.

    It has an entry per model and task and one per metric, which the job lists.
    """
    values = [F.lit(x) for row in means.collect() for x in (row["metric_name"], row["metric_value"])]
    runs = results.agg(F.collect_list(F.struct(*results.columns)).alias("runs"))
    summary = F.create_map(*values).cast("map<string,double>")
    runs.select("runs", summary.alias("summary"), F.lit(run_id).alias("run_id")).write.mode("overwrite").json(path)


def save_csv(results: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columns in name order under a header; nested values as JSON, missing ones empty."""
    columns = []
    for name in sorted(results.columns):
        nested = isinstance(results.schema[name].dataType, (T.ArrayType, T.MapType, T.StructType))
        columns.append(F.to_json(name).alias(name) if nested else F.col(name))
    writer = results.select(*columns).write.mode(mode)
    writer.option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def save_checkpoints(
    rows: DataFrame,
    path: str,
    batch_size: int,
    every_batches: int,
    finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    parts: int = PARTS,
    settings: str = "",
) -> DataFrame:
    """Put ``finish`` of the rows into a table in flush groups, and read the table.

    ``rows`` are numbered by ``idx`` and cheap to read; ``finish`` (running a model, say) adds
    what is expensive. A flush group is ``every_batches`` batches; it is a column of the result.
    Consecutive groups are finished and committed together, in ``parts`` jobs at most, without a
    shuffle between ``finish`` and the files. Started again with the same path, whether it was
    stopped or not, with other batches or more rows, a job makes only what no commit covers; what
    was made from other rows or with other ``settings`` is made anew (see :mod:`assayer.sinks.commits`).
    """
    made_with = json.dumps({"batch_size": batch_size, "every_batches": every_batches})
    stored = commits.complete(rows, path, finish, batch_size * every_batches, parts, settings, made_with)
    return stored.withColumn("flush_group", flush_group(F.col("idx"), batch_size, every_batches))
