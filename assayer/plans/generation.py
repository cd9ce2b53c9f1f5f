"""Choosing the way a model answers a task: freely, by choice, or in two phases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.reasoning import Delimiters
from assayer.operators.inference import (
    THINKING_END,
    THINKING_START,
    choose,
    generate,
    two_phase,
)
from assayer.plans.spec import ModelSpec, SpecError, TaskSpec


def mode_of(model: ModelSpec, task: TaskSpec) -> str:
    """``plain``, ``constrained`` or ``two_phase``; an error if the model cannot."""
    if not task.constrained:
        return "plain"
    if not task.choices:
        raise SpecError(f"Task '{task.name}': constrained output needs a list of choices")
    if not model.supports_constrained:
        raise RuntimeError(
            f"Model '{model.name}' has no scorer, which the constrained task '{task.name}' needs"
        )
    return "two_phase" if model.thinks else "constrained"


def predict(examples: DataFrame, model: ModelSpec, task: TaskSpec, batch_size: int | None = None) -> DataFrame:
    """Adds ``model``, ``completion`` and ``prediction_raw`` to examples with ``prompt``."""
    mode = mode_of(model, task)
    size = batch_size or model.max_batch_size
    named = examples.withColumn("model", F.lit(model.name))
    if mode == "two_phase":
        marks = task.thinking_delimiters or Delimiters()
        answered = two_phase(
            named, "prompt", task.choices, model.load_generator, model.load_scorer,
            marks.start or THINKING_START, marks.end or THINKING_END, size, task.generation_kwargs,
        )
        return answered.withColumnRenamed("raw", "prediction_raw")
    if mode == "constrained":
        choice = choose(F.col("prompt"), task.choices, model.load_scorer, size, task.generation_kwargs)
        return named.withColumn("completion", choice).withColumn("prediction_raw", F.col("completion"))
    written = generate(F.col("prompt"), model.load_generator, size, task.generation_kwargs)
    output = named.withColumn("_output", written)
    return output.select(
        *named.columns, F.col("_output.completion").alias("completion"), F.col("_output.raw").alias("prediction_raw")
    )


def predict_all(examples: DataFrame, models: Sequence[ModelSpec], task: TaskSpec, batch_size: int | None = None) -> DataFrame:
    """The predictions of every model of the job on one task."""
    return reduce(DataFrame.unionByName, (predict(examples, m, task, batch_size) for m in models))
