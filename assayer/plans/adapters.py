"""Task adapters: the five steps a kind of task may change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.choices import postprocess
from assayer.functions.fields import resolve_field
from assayer.functions.labels import LabelMap, prediction_id, reference_id
from assayer.functions.templates import render
from assayer.plans.rag import load_corpus, rag_prompts
from assayer.plans.spec import SpecError, TaskSpec

_adapters: dict[str, type[TaskAdapter]] = {}


class TaskAdapter:
    """Text in, text out. Every step takes and returns a DataFrame.

    Examples have ``idx`` and, as the struct ``row``, the fields of the dataset, whose
    names are therefore free.
    """

    def fields(self, task: TaskSpec) -> set[str]:
        """The columns of the dataset that the other steps read."""
        paths = [*task.input_mappings.values()]
        if task.retrieves:
            paths += task.query_mappings.values()
        if task.reference_field:
            paths.append(task.reference_field)
        return {path.split(".")[0] for path in paths}

    def build_prompts(self, examples: DataFrame, task: TaskSpec) -> DataFrame:
        """Add ``prompt``, and ``extra`` where context was retrieved."""
        if task.retrieves:
            return rag_prompts(examples, load_corpus(examples.sparkSession, task.rag), task)
        row, fields = F.col("row"), examples.schema["row"].dataType
        prompt = render(fields, task.prompt_template, task.input_mappings, root=row)
        return examples.withColumn("prompt", prompt)

    def extract_references(self, examples: DataFrame, task: TaskSpec) -> DataFrame:
        """Add ``actual_raw``, in the type the dataset has."""
        if not task.reference_field:
            raise SpecError(f"Task '{task.name}': a reference_field is needed")
        fields = examples.schema["row"].dataType
        reference, _ = resolve_field(fields, task.reference_field, F.col("row"))
        return examples.withColumn("actual_raw", reference)

    def postprocess(self, predictions: DataFrame, task: TaskSpec) -> DataFrame:
        """Add ``prediction_parsed``."""
        parsed = postprocess(
            F.col("completion"), task.choices, task.default, task.thinking_delimiters, task.strip_from_prediction
        )
        return predictions.withColumn("prediction_parsed", parsed)

    def normalize(self, predictions: DataFrame, task: TaskSpec) -> DataFrame:
        """Add ``prediction`` and ``actual`` as the metrics expect them."""
        parsed, raw = F.col("prediction_parsed"), F.col("actual_raw")
        if not (task.label_map and task.metrics):
            return predictions.withColumns({"prediction": parsed, "actual": raw})
        labels = LabelMap.of(task.label_map)
        dtype = predictions.schema["actual_raw"].dataType
        return predictions.withColumns(
            {"prediction": prediction_id(parsed, labels), "actual": reference_id(raw, dtype, labels)}
        )

    def collect_extras(self, examples: DataFrame, task: TaskSpec) -> list[str]:
        """Columns of per-example data to keep with the details."""
        return ["extra"] if "extra" in examples.columns else []


def register(name: str, adapter: type[TaskAdapter]) -> None:
    key = name.lower()
    if key in _adapters:
        raise ValueError(f"The task adapter '{name}' is registered already")
    _adapters[key] = adapter


def create(name: str) -> TaskAdapter:
    key = name.lower()
    if key not in _adapters:
        raise ValueError(f"Unknown task adapter '{name}'; known: {', '.join(sorted(_adapters))}")
    return _adapters[key]()


for _name in ("text_generation", "generic", "classification", "qa", "summarization"):
    register(_name, TaskAdapter)
