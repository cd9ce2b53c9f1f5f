"""Filters, samples, positions and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.joins import for_each_model, with_references
from assayer.operators.positions import batch_ledger, first_k, head, progress_rows, with_position
from assayer.operators.results import select_metrics, unpivot_metrics
from assayer.queries.registry import (
    CUSTOMERS,
    DIALOGUE,
    FRAME,
    customers,
    dialogue,
    past_results,
    query,
    sql_strip,
    table,
)
from assayer.functions.choices import postprocess
from assayer.sources.datasets import regex_filter


@query(
    "regex_filter",
    """SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE (l.quality IS NULL OR l.quality = 1) AND regexp_matches(d.text, '(?i)the\\s+of|tion\\.$')""",
)
def regex_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value is the text None; an absent column is an empty text."""
    documents = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    kept = regex_filter(documents, "quality", "^(None|1)$")
    kept = regex_filter(kept, "text", r"(?i)the\s+of|tion\.$")
    kept = regex_filter(kept, "no_such_column", "^$")
    return kept.select("doc_id", F.col("quality").cast("long"))


@query(
    "head_sample",
    "SELECT doc_id, lang, n_chars FROM documents ORDER BY source, doc_id LIMIT 100",
)
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return head(documents, ["source", "doc_id"], 100).drop("source")


@query(
    "prediction_samples",
    f"""SELECT CAST(c_nationkey AS BIGINT) AS task, string_agg({sql_strip('output')}, '|' ORDER BY c_custkey) AS samples
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM {CUSTOMERS})
    WHERE rn <= 5 GROUP BY c_nationkey""",
)
def prediction_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.operators.results import prediction_samples as samples

    scored = customers(spark, sf_dir).select(
        F.lit("m").alias("model"),
        F.col("c_nationkey").cast("long").alias("task"),
        F.col("c_custkey").alias("idx"),
        postprocess(F.col("output")).alias("prediction"),
    )
    return samples(scored, 5).select("task", F.array_join("prediction_samples", "|").alias("samples"))


@query(
    "first_events",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)
    WHERE rn <= 50""",
)
def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first examples of very large groups, by example index."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id")
    return first_k(events, ["event_type"], "event_id", 50)


@query("metric_select", f"SELECT DISTINCT metric_name FROM {FRAME} WHERE metric_name <> 'customer'")
def metric_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = unpivot_metrics(past_results(spark, sf_dir))
    return select_metrics(frame, include=["price", "customer", "other"], exclude=["customer"])


@query(
    "model_task_grid",
    f"""WITH d AS ({DIALOGUE.format(c='conversations')})
    SELECT model, turn AS task, count(*) AS n FROM d, (VALUES ('small'), ('large'), ('tiny')) m(model) GROUP BY ALL""",
)
def model_task_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = for_each_model(dialogue(spark, sf_dir), ["small", "large", "tiny"])
    return jobs.groupBy("model", F.col("turn").alias("task")).agg(F.count("*").alias("n"))


@query(
    "prediction_reference_join",
    """SELECT u.conv_id AS task, u.turn AS idx, u.text AS prediction, a.text AS reference
    FROM conversations u LEFT JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1""",
)
def prediction_reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    predictions = turns.select(
        F.col("conv_id").alias("task"), F.col("turn").alias("idx"), F.col("text").alias("prediction")
    )
    references = turns.select(
        F.col("conv_id").alias("task"), (F.col("turn") - 1).alias("idx"), F.col("text").alias("reference")
    )
    return with_references(predictions, references)


@query(
    "example_index",
    """SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS idx,
        row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS in_language FROM documents""",
)
def example_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    overall = with_position(documents, ["source", "doc_id"])
    both = with_position(overall, ["n_chars", "doc_id"], within=["lang"], name="in_language", start=1)
    return both.select("doc_id", "idx", "in_language")


_LEDGER = """WITH numbered AS (
        SELECT event_type AS task, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events),
    batches AS (SELECT task, idx // 64 + 1 AS batch, count(*) AS rows, min(idx) AS first_idx FROM numbered GROUP BY ALL),
    ledger AS (SELECT *, max(batch) OVER (PARTITION BY task) AS total_batches FROM batches)
    SELECT * FROM ledger"""


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("task"), "event_id")
    return batch_ledger(with_position(events, ["event_id"], within=["task"]), ["task"], batch_size=64)


@query("batch_ledger", _LEDGER)
def batch_ledger_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir)


@query("batch_progress", f"{_LEDGER} WHERE batch % 10 = 0 OR batch = total_batches")
def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress_rows(_ledger(spark, sf_dir), every=10)
