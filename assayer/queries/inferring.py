"""Batch inference with deterministic stand-ins for models."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.embedding import mean_pool
from assayer.operators.inference import choose, generate
from assayer.operators.retrieval import top_k
from assayer.plans.generation import predict_all
from assayer.plans.spec import ModelSpec, TaskSpec
from assayer.queries.registry import SEGMENTS, query, table


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def digest_generator():
    """Completes every prompt with its digest; the raw output repeats the prompt."""

    def run(prompts: list[str], **_) -> tuple[list[str], list[str]]:
        completions = [digest(p) for p in prompts]
        return completions, [p + c for p, c in zip(prompts, completions)]

    return run


def digest_scorer():
    """Scores a choice by the digest of prompt and choice."""

    def run(prompts: list[str], choices, **_) -> list[list[float]]:
        return [[float(int(digest(p + c)[:8], 16)) for c in choices] for p in prompts]

    return run


def _sql_choice(prompt: str) -> str:
    scored = ", ".join(
        f"{{'s': ('0x' || substr(md5({prompt} || '{c}'), 1, 8))::BIGINT, 'o': {-i}, 'c': '{c}'}}"
        for i, c in enumerate(SEGMENTS)
    )
    return f"list_max([{scored}]).c"


@query(
    "batch_infer",
    "SELECT doc_id, md5(text) AS completion, text || md5(text) AS raw FROM documents",
)
def batch_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    output = generate(F.col("text"), digest_generator, batch_size=32)
    return documents.select("doc_id", output.alias("o")).select("doc_id", "o.completion", "o.raw")


@query(
    "constrained_choice",
    """WITH pooled AS (SELECT label, dim, avg(x) AS x FROM (
            SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings) GROUP BY ALL),
    norms AS (SELECT label, sqrt(sum(x * x)) AS norm FROM pooled GROUP BY label),
    centroids AS (SELECT label, list(x / norm ORDER BY dim) AS v FROM pooled JOIN norms USING (label) GROUP BY label),
    scores AS (SELECT e.vec_id, c.label, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.v), 12) AS s FROM embeddings e, centroids c)
    SELECT vec_id, CAST(label AS VARCHAR) AS choice FROM scores QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1""",
)
def constrained_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest centroid of each vector: top-1 retrieval with the labels' centroids as the corpus."""
    vectors = table(spark, sf_dir, "embeddings")
    centroids = mean_pool(vectors, "label", "embedding", F.lit(True))
    nearest = top_k(
        vectors.select(F.col("vec_id").alias("query_id"), "embedding"),
        centroids.select(F.col("label").alias("corpus_id"), "embedding"),
        1,
    )
    return nearest.select(F.col("query_id").alias("vec_id"), F.col("corpus_id").cast("string").alias("choice"))


@query(
    "constrained_plugin",
    f"SELECT doc_id, {_sql_choice('text')} AS choice FROM documents",
)
def constrained_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", choose(F.col("text"), SEGMENTS, digest_scorer, 64).alias("choice"))


def _task(name: str, constrained: bool) -> TaskSpec:
    return TaskSpec(
        name=name,
        dataset="benchmark",
        prompt_template="{text}",
        input_mappings={"text": "text"},
        choices=SEGMENTS if constrained else (),
        constrained_output=constrained,
    )


_THOUGHT = "'<think' || md5(prompt || chr(10) || '<think') || chr(10) || '</think' || chr(10) || '<answer>'"
_PROMPTS = "(SELECT doc_id AS idx, text AS prompt FROM documents)"
_TWO_PHASE = f"""SELECT 'reasoner' AS model, idx, {_sql_choice(f'prompt || chr(10) || {_THOUGHT}')} AS completion,
    {_THOUGHT} || {_sql_choice(f'prompt || chr(10) || {_THOUGHT}')} AS prediction_raw FROM {_PROMPTS}"""


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.select(F.col("doc_id").alias("idx"), F.col("text").alias("prompt"))


PLAIN = ModelSpec("writer", digest_generator)
CHOOSER = ModelSpec("chooser", digest_generator, digest_scorer, path="models/base")
REASONER = ModelSpec("reasoner", digest_generator, digest_scorer, path="models/Deep-Reasoning-1B")


@query("two_phase_infer", _TWO_PHASE)
def two_phase_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_all(_prompts(spark, sf_dir), [REASONER], _task("t", True), 32).drop("prompt")


@query(
    "generation_modes",
    f"""SELECT 'writer' AS model, 'free' AS task, idx, md5(prompt) AS completion, prompt || md5(prompt) AS prediction_raw FROM {_PROMPTS}
    UNION ALL SELECT 'chooser', 'choice', idx, {_sql_choice('prompt')}, {_sql_choice('prompt')} FROM {_PROMPTS}
    UNION ALL SELECT model, 'choice', idx, completion, prediction_raw FROM ({_TWO_PHASE})""",
)
def generation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = _prompts(spark, sf_dir)
    free = predict_all(prompts, [PLAIN], _task("free", False), 32).withColumn("task", F.lit("free"))
    chosen = predict_all(prompts, [CHOOSER, REASONER], _task("choice", True), 32)
    both = free.unionByName(chosen.withColumn("task", F.lit("choice")))
    return both.select("model", "task", "idx", "completion", "prediction_raw")
