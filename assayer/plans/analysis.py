"""The tables behind the charts of one run, and of several runs side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from assayer.operators import results
from assayer.plans.spec import AnalysisSpec
from assayer.sources.runs import read_run_frame


def run_tables(frame: DataFrame, spec: AnalysisSpec) -> dict[str, DataFrame]:
    """Tables of one run by name.

    ``minimal`` has the means by model, ``core`` also those by task and the model by
    metric table, ``extended`` also a task by model table per metric. The model by metric
    table shows all metrics, the others the selected ones.
    """
    chosen = results.only_metrics(frame, spec.metrics_include, spec.metrics_exclude)
    tables = {"by_model": results.by_model(chosen)}
    if spec.plots in ("core", "extended"):
        tables["by_task"] = results.by_task(chosen)
        tables["summary_table"] = results.summary_table(frame)
    if spec.plots == "extended":
        for name in selected_metrics(frame, spec):
            tables[f"heatmap:{name}"] = results.heatmap(frame, name)
    return tables


def selected_metrics(frame: DataFrame, spec: AnalysisSpec) -> list[str]:
    """The chosen metric names; the job descriptions bound their number."""
    rows = results.select_metrics(frame, spec.metrics_include, spec.metrics_exclude).collect()
    return [row["metric_name"] for row in rows]


def compare(spark: SparkSession, run_dirs: Sequence[str], spec: AnalysisSpec | None = None) -> dict[str, DataFrame]:
    """Tables over several stored runs, all read in one scan."""
    spec = spec or AnalysisSpec()
    frame = read_run_frame(spark, run_dirs)
    chosen = results.only_metrics(frame, spec.metrics_include, spec.metrics_exclude)
    return {"by_run": results.compare_runs(chosen), "summary_table": results.summary_table(frame)}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """One folder of JSON lines per table."""
    for name, table in tables.items():
        table.write.mode("overwrite").json(f"{folder}/{name.replace(':', '_')}")
