"""Evaluating models on tasks, from datasets to stored results."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, is_dataclass
from datetime import datetime, timezone
from functools import reduce
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.naming import output_key
from assayer.operators import metrics
from assayer.operators.positions import head, with_file_position, with_position
from assayer.operators.results import detail_rows, run_results, summary, unpivot_metrics
from assayer.plans import adapters, analysis as analyses
from assayer.plans.generation import predict_all
from assayer.plans.spec import AnalysisSpec, EvaluationSpec, ModelSpec, SpecError, TaskSpec
from assayer.session import materialize
from assayer.sinks.writers import save_by_run, save_checkpoints, save_summary
from assayer.sources import datasets
from assayer.streaming.leaderboard import read_results, run_leaderboard


# Where examples come from and what is measured; digests of the examples tell whether these have changed.
_NOT_IN_PREDICTIONS = {"dataset", "split", "order_by", "sample_size", "metrics"}


@dataclass(frozen=True)
class Evaluation:
    """The outcome of a job: one row per model and task, means per metric, examples."""

    run_id: str
    results: DataFrame
    summary: DataFrame
    details: DataFrame | None


def load_examples(spark: SparkSession, task: TaskSpec, evaluation: EvaluationSpec) -> DataFrame:
    """The sampled dataset with ``task, idx, prompt, actual_raw`` and perhaps ``extra``."""
    adapter = adapters.create(task.task_adapter)
    if isinstance(task.dataset, DataFrame):
        rows = task.dataset
    else:
        rows = datasets.load(spark, task.dataset, task.split, with_order=not task.order_by)
    order = task.order_by or datasets.FILE_ORDER
    if not set(order) <= set(rows.columns):
        raise SpecError(f"Task '{task.name}': order_by is needed to number the examples")
    sample = task.sample_size or evaluation.sample_size
    if sample and not task.order_by:
        rows = datasets.first_rows(rows, sample)
    rows = head(rows, order, sample)
    kept = adapter.fields(task).union(order, () if task.order_by else (datasets.FILE_SPLIT,))
    rows = rows.select(F.struct(*(c for c in rows.columns if c in kept)).alias("row"))
    if task.order_by or sample:
        examples = with_position(rows, [f"row.{column}" for column in order])
    else:
        file, row = (f"row.{column}" for column in datasets.FILE_ORDER)
        examples = with_file_position(rows, file, f"row.{datasets.FILE_SPLIT}", row)
    examples = adapter.build_prompts(examples, task)
    wants_references = task.metrics or (evaluation.save_detailed and task.reference_field)
    if wants_references:
        examples = adapter.extract_references(examples, task)
    else:
        examples = examples.withColumn("actual_raw", F.lit(None).cast("string"))
    return examples.select(
        F.lit(task.name).alias("task"), "idx", "prompt", "actual_raw", *adapter.collect_extras(examples, task)
    )


def score(predictions: DataFrame, task: TaskSpec) -> DataFrame:
    """Adds ``prediction_parsed, prediction, actual``."""
    adapter = adapters.create(task.task_adapter)
    return adapter.normalize(adapter.postprocess(predictions, task), task)


def compute_metrics(scored: DataFrame, task: TaskSpec) -> DataFrame | None:
    if not task.metrics:
        return None
    pairs = scored.select("model", "task", "idx", "prediction", F.col("actual").alias("reference"))
    return metrics.compute_all(pairs, task.metrics)


def evaluate(
    spark: SparkSession,
    models: Sequence[ModelSpec],
    tasks: Sequence[TaskSpec],
    evaluation: EvaluationSpec | None = None,
    analysis: AnalysisSpec | None = None,
    run_id: str | None = None,
) -> Evaluation:
    """Run every model on every task.

    Under ``output_dir``, ``results`` and ``examples`` collect the rows of all runs by run,
    model and task; ``<run id>`` holds the summary, checkpoints and tables of this one.
    A ``run_id`` of an earlier run goes on from its checkpoints, also with other batches or more
    examples; predictions they hold are not made again, and what is stored of the run is replaced. Prompts are built once per task, whatever the number of models. Parsed predictions are
    written before they are measured, so no metric runs a model again.
    """
    evaluation = evaluation or EvaluationSpec()
    run_id = run_id or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")

    def scored_rows(task: TaskSpec) -> DataFrame:
        examples = materialize(load_examples(spark, task, evaluation), "examples")

        def scored(rows: DataFrame) -> DataFrame:
            return score(predict_all(rows, models, task, evaluation.batch_size), task)

        written = _written(examples, scored, models, task, evaluation, run_id)
        if follows:
            _follow(_results(written, models, task, evaluation, run_id), f"{evaluation.output_dir}/results", folder, run_id, board)
        return written

    folder = f"{evaluation.output_dir}/{run_id}"
    follows, board = bool(analysis and analysis.follows and evaluation.output_dir), Lock()
    # Tasks do not depend on each other, so a few of them share the cluster at a time.
    with ThreadPoolExecutor(evaluation.max_concurrent) as pool:
        scored = list(pool.map(inheritable_thread_target(spark)(scored_rows), tasks))
    results = [_results(s, models, t, evaluation, run_id) for s, t in zip(scored, tasks)]
    details = [_details(s, t, evaluation) for s, t in zip(scored, tasks) if evaluation.save_detailed]
    all_results = materialize(reduce(DataFrame.unionByName, results), "results")
    all_details = reduce(DataFrame.unionByName, details) if details else None
    frame = unpivot_metrics(all_results)
    means = summary(frame)
    if evaluation.output_dir:
        if not follows:
            save_by_run(all_results, f"{evaluation.output_dir}/results", mode="replace")
        save_summary(all_results, means, run_id, f"{folder}/summary.json")
        if all_details is not None:
            examples = all_details.withColumn("run_id", F.lit(run_id))
            save_by_run(examples, f"{evaluation.output_dir}/examples", mode="replace")
        if analysis and analysis.enabled:
            tables = analyses.run_tables(frame, analysis)
            analyses.write_tables(tables, analysis.output_dir or f"{folder}/analysis")
            if analysis.compare_runs:
                compared = analyses.compare(spark, analysis.compare_runs, analysis)
                analyses.write_tables(compared, f"{folder}/compare")
    return Evaluation(run_id, all_results, means, all_details)


def _follow(results: DataFrame, stored: str, folder: str, run_id: str, board: Lock) -> None:
    """Store the results of a task and bring the run's leaderboard up to date."""
    with board:
        save_by_run(results, stored, mode="replace")
        arrived = read_results(results.sparkSession, f"{stored}/run_id={run_id}")
        run_leaderboard(arrived, f"{folder}/leaderboard", f"{folder}/leaderboard-progress", replaced=True).awaitTermination()


def _written(
    examples: DataFrame,
    scored: Callable[[DataFrame], DataFrame],
    models: Sequence[ModelSpec],
    task: TaskSpec,
    evaluation: EvaluationSpec,
    run_id: str,
) -> DataFrame:
    """The scored predictions, stored; with checkpoints, group by group in the folder of the run."""
    if not (evaluation.checkpoint_batches and evaluation.output_dir):
        return materialize(scored(examples), "predictions")
    key = examples.sparkSession.range(1).select(output_key(F.lit(task.name))).first()[0]
    path = f"{evaluation.output_dir}/{run_id}/checkpoints/{key}"
    settings = _settings(models, task)
    stored = save_checkpoints(examples, path, evaluation.batch_size, evaluation.checkpoint_batches, scored, settings=settings)
    return stored.drop("flush_group")


def _settings(models: Sequence[ModelSpec], task: TaskSpec) -> str:
    """What predictions depend on besides their prompts; the same in every process."""
    described = [{k: v for k, v in _fields(x).items() if k not in _NOT_IN_PREDICTIONS} for x in (*models, task)]
    return json.dumps(described, sort_keys=True, default=lambda x: _fields(x) if is_dataclass(x) else type(x).__qualname__)


def _fields(described: Any) -> dict[str, Any]:
    return {f.name: getattr(described, f.name) for f in fields(described)}


def _results(
    scored: DataFrame, models: Sequence[ModelSpec], task: TaskSpec, evaluation: EvaluationSpec, run_id: str
) -> DataFrame:
    rows = run_results(
        scored.withColumn("prediction", F.col("prediction").cast("string")),
        compute_metrics(scored, task),
        evaluation.prediction_sample_size,
        task.task_adapter,
    )
    tokens = F.lit(None).cast("string")
    for model in models:
        if model.special_tokens:
            named = F.lit(json.dumps(model.special_tokens))
            tokens = F.when(F.col("model") == model.name, named).otherwise(tokens)
    return rows.withColumns({"run_id": F.lit(run_id), "model_special_tokens": tokens})


def _details(scored: DataFrame, task: TaskSpec, evaluation: EvaluationSpec) -> DataFrame:
    if "extra" in scored.columns:
        scored = scored.withColumn("extra", F.to_json("extra"))
    else:
        scored = scored.withColumn("extra", F.lit("{}"))
    as_text = {c: F.col(c).cast("string") for c in ("prediction", "actual", "actual_raw")}
    return detail_rows(scored.withColumns(as_text), task.thinking_delimiters, evaluation.max_detailed_examples)
