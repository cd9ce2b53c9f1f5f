"""Run ids, output keys and model flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout of run ids, and path parts that mark a reasoning model.
RUN_ID_FORMAT = "yyyyMMdd_HHmmss"
REASONING_PATH = "thinking|reasoning"


def run_id(utc_time: Column) -> Column:
    """The id of a run that started at a UTC wall-clock time."""
    return F.date_format(utc_time, RUN_ID_FORMAT)


def output_key(model: Column) -> Column:
    """A model name that is safe as a folder name."""
    return F.translate(model, "/ ", "__")


def is_reasoning_model(explicit: Column, path: Column) -> Column:
    """The configured flag, else whether the model path says so."""
    return F.coalesce(explicit, F.lower(path).rlike(REASONING_PATH))


def completion_of(raw: Column, prompt: Column) -> Column:
    """What a model wrote after its prompt."""
    return F.when(raw.startswith(prompt), F.substr(raw, F.length(prompt) + 1)).otherwise(raw)
