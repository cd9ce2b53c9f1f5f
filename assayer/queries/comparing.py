"""Run results, their summaries, pivots and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import metrics, results
from assayer.queries.registry import (
    FRAME,
    past_results,
    query,
    rounded,
    table,
)
from assayer.queries.scoring import SCORED, classified

# Fixed lists name the pivot columns.
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.unpivot_metrics(past_results(spark, sf_dir))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("metric_value", rounded("metric_value"))


# The numbers, flags, texts and nulls of an event as the metrics of a result.
_METRICS = """replace(props, '}', ', "kind": "' || event_type || '", "ok": true, "none": null, "share": 0.' || event_id || '}')"""


@query(
    "metrics_unpivot",
    """SELECT 'r' AS run_id, event_type AS model, CAST(event_id AS VARCHAR) AS task, unnest(['k', 'ok', 'share']) AS metric_name,
        unnest([CAST(props ->> '$.k' AS DOUBLE), 1.0, CAST('0.' || event_id AS DOUBLE)]) AS metric_value, user_id AS num_examples
    FROM events""",
)
def metrics_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as read from JSON, of which only numbers and flags count."""
    parsed = F.from_json(F.expr(_METRICS), "map<string,variant>")
    rows = table(spark, sf_dir, "events").select(
        F.lit("r").alias("run_id"),
        F.col("event_type").alias("model"),
        F.col("event_id").cast("string").alias("task"),
        parsed.alias("metrics"),
        F.col("user_id").alias("num_examples"),
    )
    return results.unpivot_metrics(rows)


@query(
    "run_results",
    f"""WITH {SCORED}, firsts AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY model, task ORDER BY idx) <= 5),
    samples AS (SELECT model, task, string_agg(CAST(prediction AS VARCHAR), ',' ORDER BY idx) AS samples FROM firsts GROUP BY ALL)
    SELECT model, task, 'classification' AS task_adapter, count(*) AS num_examples, samples,
        round(avg(CASE WHEN prediction = reference THEN 1 ELSE 0 END), 6) AS accuracy,
        round(avg(CASE WHEN prediction = reference THEN 1 ELSE 0 END), 6) AS exact_match
    FROM scored JOIN samples USING (model, task) GROUP BY model, task, samples""",
)
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classified(spark, sf_dir)
    found = metrics.compute_all(scored, ["accuracy", ("exact_match", {})])
    rows = results.run_results(scored, found, samples=5, adapter="classification")

    def metric(name: str):
        return rounded(F.col("metrics").getItem(name))

    return rows.select(
        "model",
        "task",
        "task_adapter",
        "num_examples",
        F.array_join(F.transform("prediction_samples", lambda p: p.cast("string")), ",").alias("samples"),
        metric("accuracy:accuracy").alias("accuracy"),
        metric("exact_match:exact_match").alias("exact_match"),
    )


@query(
    "summary_mean",
    f"SELECT metric_name, round(avg(metric_value), 6) AS metric_value FROM {FRAME} GROUP BY metric_name",
)
def summary_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(results.summary(_frame(spark, sf_dir)))


@query(
    "summary_report",
    f"""WITH lines AS (SELECT metric_name, '- ' || metric_name || ': ' || printf('%.4f', avg(metric_value)) AS line FROM {FRAME} GROUP BY metric_name)
    SELECT 0 AS line_number, 'Summary metrics:' AS line
    UNION ALL SELECT CAST(row_number() OVER (ORDER BY metric_name) AS INTEGER), line FROM lines""",
)
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.report(_frame(spark, sf_dir))


@query(
    "metric_by_model",
    f"SELECT metric_name, model, round(avg(metric_value), 6) AS metric_value FROM {FRAME} GROUP BY ALL",
)
def metric_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(results.by_model(_frame(spark, sf_dir)))


@query(
    "metric_by_task",
    f"SELECT metric_name, task, model, round(avg(metric_value), 6) AS metric_value, count(*) AS n FROM {FRAME} GROUP BY ALL",
)
def metric_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(results.by_task(_frame(spark, sf_dir)))


_HEAT = ", ".join(
    f"""round(avg(metric_value) FILTER (model = '{p}'), 6) AS "{p}" """ for p in PRIORITIES
)


@query("metric_heatmap", f"SELECT task, {_HEAT} FROM {FRAME} WHERE metric_name = 'price' GROUP BY task")
def metric_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = results.heatmap(_frame(spark, sf_dir), "price", PRIORITIES)
    return pivoted.select("task", *(rounded(f"`{p}`").alias(p) for p in PRIORITIES))


@query(
    "metric_summary_table",
    f"""SELECT model, round(avg(metric_value) FILTER (metric_name = 'customer'), 6) AS customer,
        round(avg(metric_value) FILTER (metric_name = 'price'), 6) AS price FROM {FRAME} GROUP BY model""",
)
def metric_summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivoted = results.summary_table(_frame(spark, sf_dir), ["customer", "price"])
    return pivoted.select("model", *(rounded(m).alias(m) for m in ("customer", "price")))


@query(
    "compare_runs",
    f"""WITH frame AS (SELECT run_id, model, CASE WHEN metric_name = 'price' THEN task ELSE 'all' END AS task, metric_name, metric_value FROM {FRAME}),
    axes AS (SELECT metric_name, count(DISTINCT task) > 1 AS many FROM frame GROUP BY metric_name)
    SELECT metric_name, CASE WHEN many THEN 'task' ELSE 'model' END AS axis, CASE WHEN many THEN task ELSE model END AS category,
        run_id, round(avg(metric_value), 6) AS metric_value
    FROM frame JOIN axes USING (metric_name) GROUP BY ALL""",
)
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric covers several tasks, the other a single one."""
    frame = _frame(spark, sf_dir)
    single = F.when(F.col("metric_name") == "price", F.col("task")).otherwise(F.lit("all"))
    return _rounded(results.compare_runs(frame.withColumn("task", single)))


@query(
    "runs_union",
    f"""SELECT run_id, model, metric_name, count(*) AS n, round(avg(metric_value), 6) AS metric_value, count(task) AS with_task
    FROM (SELECT run_id, model, task, metric_name, metric_value FROM {FRAME}
        UNION ALL SELECT 'extra', event_type, NULL, 'value', value FROM events) GROUP BY ALL""",
)
def runs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = table(spark, sf_dir, "events").select(
        F.lit("extra").alias("run_id"),
        F.col("event_type").alias("model"),
        F.lit("value").alias("metric_name"),
        F.col("value").alias("metric_value"),
    )
    both = results.union_runs([_frame(spark, sf_dir), extra])
    return both.groupBy("run_id", "model", "metric_name").agg(
        F.count("*").alias("n"),
        rounded(F.avg("metric_value")).alias("metric_value"),
        F.count("task").alias("with_task"),
    )
