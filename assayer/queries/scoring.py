"""Metrics over predictions and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.choices import postprocess
from assayer.functions.labels import UNKNOWN, LabelMap, prediction_id, reference_id
from assayer.functions.reasoning import Delimiters
from assayer.operators import metrics, rouge
from assayer.operators.resampling import bootstrap, weight_sql
from assayer.plans import adapters
from assayer.plans.evaluation import score
from assayer.plans.spec import TaskSpec
from assayer.queries.registry import (
    CUSTOMERS,
    DIALOGUE,
    SEGMENTS,
    customers,
    dialogue,
    query,
    rounded,
    sql_choice,
    sql_label,
    sql_strip,
    sql_thinking,
    table,
)


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers scored twice: from the free text, and from the extracted choice."""
    labels = LabelMap.of(SEGMENTS)
    df = customers(spark, sf_dir)
    think = Delimiters("<think>", "</think>")
    output = F.col("output")
    models = F.array(
        F.struct(F.lit("choice").alias("model"), postprocess(output, SEGMENTS, None, think, True).alias("text")),
        F.struct(F.lit("free").alias("model"), postprocess(output).alias("text")),
    )
    reference = reference_id(F.col("c_mktsegment"), df.schema["c_mktsegment"].dataType, labels)
    return df.select(
        F.col("c_nationkey").cast("string").alias("task"),
        F.col("c_custkey").alias("idx"),
        reference.alias("reference"),
        F.inline(models),
    ).withColumn("prediction", prediction_id(F.col("text"), labels))


SCORED = f"""parts AS (SELECT c_custkey, c_nationkey, c_mktsegment, output, {sql_thinking('output')} FROM {CUSTOMERS}),
    answers AS (SELECT *, {sql_strip('CASE WHEN marked THEN after ELSE output END')} AS answer FROM parts),
    texts AS (SELECT c_custkey, c_nationkey, c_mktsegment, 'choice' AS model, {sql_choice('answer', SEGMENTS[0])} AS text FROM answers
        UNION ALL SELECT c_custkey, c_nationkey, c_mktsegment, 'free', output FROM answers),
    scored AS (SELECT model, CAST(c_nationkey AS VARCHAR) AS task, c_custkey AS idx, {sql_label('text')} AS prediction,
        {sql_label('c_mktsegment')} AS reference FROM texts)"""


@query(
    "metric_accuracy",
    f"""WITH {SCORED} SELECT model, task, 'accuracy:accuracy' AS metric_name,
        round(avg(CASE WHEN prediction = reference THEN 1 ELSE 0 END), 6) AS metric_value,
        count(*) FILTER (prediction = -1) AS n_unknown
    FROM scored GROUP BY model, task""",
)
def metric_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classified(spark, sf_dir)
    unknown = scored.groupBy("model", "task").agg(
        F.count_if(F.col("prediction") == UNKNOWN).alias("n_unknown")
    )
    found = metrics.compute(scored, "accuracy").withColumn("metric_value", rounded("metric_value"))
    return found.join(unknown, ["model", "task"])


@query(
    "metric_exact_match",
    f"""WITH d AS ({DIALOGUE.format(c='conversations')})
    SELECT 'echo' AS model, CAST(turn AS VARCHAR) AS task, 'exact_match:exact_match' AS metric_name,
        round(avg(CASE WHEN upper(left(question, 1)) = upper(left(answer, 1)) THEN 1 ELSE 0 END), 6) AS metric_value
    FROM d GROUP BY turn""",
)
def metric_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does the answer begin with the same letter as the question?"""
    scored = dialogue(spark, sf_dir).select(
        F.lit("echo").alias("model"),
        F.col("turn").cast("string").alias("task"),
        F.upper(F.left("question", F.lit(1))).alias("prediction"),
        F.upper(F.left("answer", F.lit(1))).alias("reference"),
    )
    return metrics.compute(scored, "exact_match").withColumn("metric_value", rounded("metric_value"))


_PER_LABEL = """sides AS (
        SELECT model, task, prediction AS label, CASE WHEN prediction = reference THEN 1 ELSE 0 END AS hit, 1 AS p, 0 AS r FROM scored
        UNION ALL SELECT model, task, reference, 0, 0, 1 FROM scored),
    labels AS (SELECT model, task, label, sum(hit) AS hit, sum(p) AS p, sum(r) AS r FROM sides GROUP BY ALL),
    ratios AS (SELECT *, CASE WHEN p > 0 THEN hit / p ELSE 0 END AS pr, CASE WHEN r > 0 THEN hit / r ELSE 0 END AS rc, 2 * hit / (p + r) AS f FROM labels)"""


@query(
    "metric_prf_macro",
    f"""WITH {SCORED}, {_PER_LABEL} SELECT model, task, round(avg(pr), 6) AS "precision", round(avg(rc), 6) AS recall, round(avg(f), 6) AS f1
    FROM ratios GROUP BY model, task""",
)
def metric_prf_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_prf(metrics.precision_recall_f1(classified(spark, sf_dir), "macro"))


@query(
    "metric_prf_micro",
    f"""WITH {SCORED}, {_PER_LABEL} SELECT model, task, round(sum(hit) / sum(p), 6) AS "precision",
        round(sum(hit) / sum(r), 6) AS recall, round(2 * sum(hit) / (sum(p) + sum(r)), 6) AS f1
    FROM labels GROUP BY model, task""",
)
def metric_prf_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_prf(metrics.precision_recall_f1(classified(spark, sf_dir), "micro"))


@query(
    "metric_prf_weighted",
    f"""WITH {SCORED}, {_PER_LABEL} SELECT model, task, round(sum(pr * r) / sum(r), 6) AS "precision",
        round(sum(rc * r) / sum(r), 6) AS recall, round(sum(f * r) / sum(r), 6) AS f1
    FROM ratios GROUP BY model, task""",
)
def metric_prf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_prf(metrics.precision_recall_f1(classified(spark, sf_dir), "weighted"))


@query(
    "metric_prf_binary",
    f"""WITH {SCORED}, {_PER_LABEL} SELECT model, task, round(coalesce(max(pr) FILTER (label = 1), 0), 6) AS "precision",
        round(coalesce(max(rc) FILTER (label = 1), 0), 6) AS recall, round(coalesce(max(f) FILTER (label = 1), 0), 6) AS f1
    FROM ratios GROUP BY model, task""",
)
def metric_prf_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_prf(metrics.precision_recall_f1(classified(spark, sf_dir), "binary", pos_label=1))


def _rounded_prf(values: DataFrame) -> DataFrame:
    names = ("precision", "recall", "f1")
    return values.select("model", "task", *(rounded(n).alias(n) for n in names))


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models that repeat parts of the dialogue, against the answer given in it."""
    predictions = F.array(
        F.struct(F.lit("echo").alias("model"), F.col("question").alias("prediction")),
        F.struct(F.lit("verbose").alias("model"), F.col("longer").alias("prediction")),
    )
    return dialogue(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("task"),
        F.col("turn").alias("idx"),
        F.col("answer").alias("reference"),
        F.inline(predictions),
    )


_PAIRS = f"""d AS ({DIALOGUE.format(c='conversations')}),
    scored AS (SELECT 'echo' AS model, CAST(conv_id AS VARCHAR) AS task, turn AS idx, question AS prediction, answer AS reference FROM d
        UNION ALL SELECT 'verbose', CAST(conv_id AS VARCHAR), turn, longer, answer FROM d)"""

# Overlap of the grams of every scored pair; {gram} lists the grams of a token list t.
_OVERLAP = """tokens AS (
        SELECT {keys}, side, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t
        FROM (SELECT {keys}, 'p' AS side, prediction AS text FROM scored UNION ALL SELECT {keys}, 'r', reference FROM scored)),
    grams AS (SELECT {keys}, side, unnest({gram}) AS g FROM tokens),
    counts AS (SELECT {keys}, g, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM grams GROUP BY ALL),
    totals AS (SELECT {keys}, sum(least(p, r)) AS common, sum(p) AS p, sum(r) AS r FROM counts GROUP BY ALL),
    measures AS (SELECT {keys}, CASE WHEN common > 0 THEN 2.0 * common / (p + r) ELSE 0 END AS f
        FROM (SELECT DISTINCT {keys} FROM scored) LEFT JOIN totals USING ({keys}))"""
_UNIGRAM = "t"
_BIGRAM = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"


def _rouge_sql(gram: str, name: str) -> str:
    overlap = _OVERLAP.format(keys="model, task, idx", gram=gram)
    return f"""WITH {_PAIRS}, {overlap} SELECT model, task, 'rouge:{name}' AS metric_name, round(avg(f), 6) AS metric_value
    FROM measures GROUP BY model, task"""


@query("metric_rouge1", _rouge_sql(_UNIGRAM, "rouge1"))
def metric_rouge1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, "rouge1")


@query("metric_rouge2", _rouge_sql(_BIGRAM, "rouge2"))
def metric_rouge2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, "rouge2")


@query("metric_rougeL")
def metric_rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, "rougeL")


@query("metric_rougeLsum")
def metric_rouge_lsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rouge(spark, sf_dir, "rougeLsum")


def _rouge(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    found = metrics.compute(_summaries(spark, sf_dir), "rouge", rouge_types=[kind])
    return found.withColumn("metric_value", rounded("metric_value"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the next one, whole texts."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("prediction"))
    following = documents.select((F.col("idx") - 1).alias("idx"), F.col("prediction").alias("reference"))
    return documents.join(following, "idx")


_NEIGHBOURS = """scored AS (SELECT a.doc_id AS idx, a.text AS prediction, b.text AS reference
    FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""


@query(
    "rouge_documents",
    f"""WITH {_NEIGHBOURS}, {_OVERLAP.format(keys='idx', gram=_UNIGRAM).replace('measures', 'one').replace('tokens', 'tokens1').replace('grams', 'grams1').replace('counts', 'counts1').replace('totals', 'totals1')},
    {_OVERLAP.format(keys='idx', gram=_BIGRAM).replace('measures', 'two')}
    SELECT idx, round(one.f, 6) AS rouge1, round(two.f, 6) AS rouge2 FROM one JOIN two USING (idx)""",
)
def rouge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = rouge.rouge_n(_neighbours(spark, sf_dir), (1, 2), keys=["idx"])
    return scores.select("idx", rounded("rouge1").alias("rouge1"), rounded("rouge2").alias("rouge2"))


@query("rouge_l_documents")
def rouge_l_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = rouge.rouge_l(_neighbours(spark, sf_dir), keys=["idx"])
    return scores.select("idx", rounded("rougeL").alias("rougeL"), rounded("rougeLsum").alias("rougeLsum"))


def _length_sums(predictions: list, references: list, unit: int = 1) -> dict[str, float]:
    pairs = [(p or "", r or "") for p, r in zip(predictions, references)]
    return {
        "rows": len(pairs),
        "gap": sum(abs(len(p) - len(r)) / unit for p, r in pairs),
        "shorter": sum(len(p) < len(r) for p, r in pairs),
    }


@query(
    "metric_custom_udaf",
    f"""WITH d AS ({DIALOGUE.format(c='conversations')}),
    sums AS (SELECT CAST(turn AS VARCHAR) AS task, avg(abs(length(question) - length(answer)) / 10) AS gap,
        avg(CASE WHEN length(question) < length(answer) THEN 1 ELSE 0 END) AS shorter FROM d GROUP BY turn)
    SELECT 'echo' AS model, task, 'length:mean_gap' AS metric_name, round(gap, 6) AS metric_value FROM sums
    UNION ALL SELECT 'echo', task, 'length:share_shorter', round(shorter, 6) FROM sums""",
)
def metric_custom_udaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric with a Python body: sums per batch, added and divided by Spark."""
    metrics.register_python(
        "length",
        _length_sums,
        lambda sums: {
            "mean_gap": sums["gap"] / sums["rows"],
            "share_shorter": sums["shorter"] / sums["rows"],
        },
    )
    scored = dialogue(spark, sf_dir).select(
        F.lit("echo").alias("model"),
        F.col("turn").cast("string").alias("task"),
        F.col("question").alias("prediction"),
        F.col("answer").alias("reference"),
    )
    return metrics.compute(scored, "length", unit=10).withColumn("metric_value", rounded("metric_value"))


@query(
    "metric_bootstrap",
    f"""WITH {SCORED}, s AS (SELECT model, task, idx, CASE WHEN prediction = reference THEN 1.0 ELSE 0.0 END AS score FROM scored),
    w AS (SELECT model, task, score, r, {weight_sql('idx', 'r')} AS weight FROM s, range(1000) t(r)),
    m AS (SELECT model, task, r, sum(weight * score) / sum(weight) AS mean FROM w GROUP BY ALL HAVING sum(weight) > 0),
    q AS (SELECT model, task, quantile_cont(mean, 0.5) AS median, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY ALL)
    SELECT model, task, round(p.mean, 6) AS mean, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high, n
    FROM (SELECT model, task, avg(score) AS mean, count(*) AS n FROM s GROUP BY ALL) p JOIN q USING (model, task)""",
)
def metric_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy per model and task with the median and the interval of 1,000 resampled means."""
    scores = classified(spark, sf_dir).withColumn("score", (F.col("prediction") == F.col("reference")).cast("double"))
    found = bootstrap(scores, ["model", "task"], "idx", "score")
    return found.select("model", "task", *(rounded(c).alias(c) for c in ("mean", "median", "low", "high")), "n")


@query(
    "metric_adapter",
    f"""WITH {SCORED} SELECT model, task, 'agreement:rate' AS metric_name,
        round(avg(CASE WHEN prediction = reference THEN 1 ELSE 0 END), 6) AS metric_value FROM scored GROUP BY model, task""",
)
def metric_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of a job that an adapter of its own computes, chosen by name."""

    def agreement(scored: DataFrame, name: str, args) -> DataFrame:
        hit = F.avg((F.col("prediction") == F.col("reference")).cast("double"))
        return scored.groupBy("model", "task").agg(hit.alias("metric_value")).withColumn("metric_name", F.lit(f"{name}:{args['as']}"))

    metrics.register_adapter("agreement", agreement)
    found = metrics.compute_all(classified(spark, sf_dir), [("agreement", {"as": "rate"}, "agreement")])
    return found.select("model", "task", "metric_name", rounded("metric_value").alias("metric_value"))


class _Shouted(adapters.TaskAdapter):
    """Answers are what stands behind the last space, in upper case."""

    def postprocess(self, predictions: DataFrame, task: TaskSpec) -> DataFrame:
        parsed = super().postprocess(predictions, task)
        return parsed.withColumn("prediction_parsed", F.upper(F.substring_index("prediction_parsed", " ", -1)))


@query(
    "task_adapter",
    f"""SELECT c_custkey AS idx, upper(list_last(string_split(t, ' '))) AS prediction, c_mktsegment AS actual
    FROM (SELECT c_custkey, c_mktsegment, {sql_strip('output')} AS t FROM {CUSTOMERS})""",
)
def task_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A kind of task of its own, chosen by name, between stored completions and scores."""
    adapters.register("shouted", _Shouted)
    task = TaskSpec(name="segments", dataset="customer", prompt_template="{name}", input_mappings={"name": "c_name"}, reference_field="c_mktsegment", task_adapter="shouted")
    completions = customers(spark, sf_dir).select(
        F.lit("m").alias("model"), F.lit("segments").alias("task"), F.col("c_custkey").alias("idx"),
        F.col("output").alias("completion"), F.col("c_mktsegment").alias("actual_raw"),
    )
    return score(completions, task).select("idx", "prediction", "actual")
