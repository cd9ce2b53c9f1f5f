"""Projections: field paths, templates, reasoning sections, choices, labels, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.choices import extract_choice, is_constrained, postprocess
from assayer.functions.fields import resolve_field
from assayer.functions.labels import LabelMap, prediction_id, reference_id
from assayer.functions.naming import completion_of, is_reasoning_model, output_key, run_id
from assayer.functions.reasoning import Delimiters, split_reasoning
from assayer.functions.templates import render
from assayer.operators.inference import answer_prompt, reasoning_part, thinking_prompt
from assayer.operators.results import detail_rows
from assayer.plans.spec import RagSpec, TaskSpec
from assayer.queries.registry import (
    CUSTOMERS,
    SEGMENTS,
    customers,
    query,
    sql_choice,
    sql_label,
    sql_strip,
    sql_thinking,
    table,
)

THINK = Delimiters(start="<think>", end="</think>")


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a translation dataset with a list of answers."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.struct(F.col("c_name").alias("en")).alias("translation"),
        F.array(F.struct(F.col("c_mktsegment").alias("text")), F.struct(F.col("c_name").alias("text"))).alias("answers"),
        F.create_map(F.lit("nation"), F.col("c_nationkey")).alias("about"),
    )


@query(
    "field_path",
    """SELECT c_custkey, c_name AS translated, c_name AS second_answer,
        CAST(c_nationkey AS BIGINT) AS nation FROM customer""",
)
def field_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir)

    def at(path: str):
        return resolve_field(df.schema, path)[0]

    return df.select(
        "c_custkey",
        at("translation.en").alias("translated"),
        at("answers.1.text").alias("second_answer"),
        at("about.nation").cast("long").alias("nation"),
    )


@query("reference_extract", "SELECT c_custkey AS idx, c_mktsegment AS reference FROM customer")
def reference_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _nested(spark, sf_dir)
    reference, _ = resolve_field(df.schema, "answers.0.text")
    return df.select(F.col("c_custkey").alias("idx"), reference.alias("reference"))


@query(
    "prompt_template",
    """SELECT c_custkey, '{' || c_name || '} of nation ' || printf('%3d', c_nationkey) || ' owes '
        || printf('%.1f', c_acctbal) || ' of ' || printf('%09.2f', c_acctbal) || ' ('
        || CAST(c_acctbal AS VARCHAR) || ') in ' || rpad(c_mktsegment, 12, '.') || CASE WHEN c_acctbal < 0
        THEN 'True' ELSE 'False' END || ' ' || CASE WHEN c_nationkey = 0 THEN 'None' ELSE CAST(c_nationkey AS VARCHAR) END AS prompt
    FROM customer""",
)
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumns(
        {
            "debtor": F.col("c_acctbal") < 0,
            "known_nation": F.when(F.col("c_nationkey") != 0, F.col("c_nationkey")),
        }
    )
    template = (
        "{{{name}}} of nation {nation:3d} owes {balance:.1f} of {balance:09.2f} ({balance}) "
        "in {segment:.<12}{debtor} {known}"
    )
    mappings = {
        "name": "c_name",
        "nation": "c_nationkey",
        "balance": "c_acctbal",
        "segment": "c_mktsegment",
        "debtor": "debtor",
        "known": "known_nation",
    }
    return df.select("c_custkey", render(df.schema, template, mappings).alias("prompt"))


@query(
    "rag_query_render",
    "SELECT item_id, 'Context: ' || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS query FROM benchmark",
)
def rag_query_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query template and its mappings default to those of the prompt."""
    task = TaskSpec(
        name="qa",
        dataset="benchmark",
        prompt_template="Context: {context}\nQuestion: {question}\nAnswer:",
        input_mappings={"question": "text"},
        rag=RagSpec(
            enabled=True,
            corpus="documents",
            corpus_template="{text}",
            corpus_mappings={"text": "text"},
            embedder="hashed",
        ),
    )
    df = table(spark, sf_dir, "benchmark")
    rendered = render(df.schema, task.query_template, task.query_mappings)
    return df.select("item_id", rendered.alias("query"))


@query(
    "corpus_render",
    "SELECT doc_id AS corpus_id, '[' || lang || '/' || source || '] ' || text AS text FROM documents",
)
def corpus_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    mappings = {"lang": "lang", "source": "source", "text": "text"}
    rendered = render(df.schema, "[{lang}/{source}] {text}", mappings)
    return df.select(F.col("doc_id").alias("corpus_id"), rendered.alias("text"))


@query(
    "thinking_split",
    f"""WITH parts AS (SELECT c_custkey, output, {sql_thinking('output')} FROM {CUSTOMERS})
    SELECT c_custkey, CASE WHEN marked THEN {sql_strip('body')} END AS thinking,
        CASE WHEN marked THEN {sql_strip('after')} ELSE output END AS after_end,
        CASE WHEN marked THEN {sql_strip('before || after')} ELSE output END AS removed,
        CASE WHEN marked THEN {sql_strip('before')} ELSE output END AS before_start,
        CASE WHEN marked THEN {sql_strip('output')} ELSE output END AS unchanged,
        CASE WHEN marked THEN '<think>' || body || '</think>' END AS kept
    FROM parts""",
)
def thinking_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(field: str, **settings):
        return split_reasoning(F.col("output"), Delimiters("<think>", "</think>", **settings))[field]

    return customers(spark, sf_dir).select(
        "c_custkey",
        part("thinking").alias("thinking"),
        part("answer").alias("after_end"),
        part("answer", mode="remove").alias("removed"),
        part("answer", mode="before_start").alias("before_start"),
        part("answer", mode="none").alias("unchanged"),
        part("thinking", keep_delimiters=True).alias("kept"),
    )


@query(
    "thinking_split_end_only",
    f"""WITH parts AS (
        SELECT c_custkey, output, contains(output, '</think>') AS marked,
            string_split(output, '</think>')[-1] AS after FROM {CUSTOMERS}),
    halves AS (SELECT *, left(output, length(output) - length(after) - 8) AS before FROM parts)
    SELECT c_custkey, CASE WHEN marked THEN {sql_strip('before')} END AS thinking,
        CASE WHEN marked THEN {sql_strip('after')} ELSE output END AS after_end,
        CASE WHEN marked THEN {sql_strip('before')} ELSE output END AS before_start
    FROM halves""",
)
def thinking_split_end_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(field: str, mode: str):
        return split_reasoning(F.col("output"), Delimiters(end="</think>", mode=mode))[field]

    return customers(spark, sf_dir).select(
        "c_custkey",
        part("thinking", "after_end").alias("thinking"),
        part("answer", "remove").alias("after_end"),
        part("answer", "before_start").alias("before_start"),
    )


@query(
    "prediction_postprocess",
    f"""WITH parts AS (SELECT c_custkey, output, {sql_thinking('output')} FROM {CUSTOMERS}),
    answers AS (SELECT c_custkey, {sql_strip('output')} AS whole,
        {sql_strip('CASE WHEN marked THEN after ELSE output END')} AS answer FROM parts)
    SELECT c_custkey, whole, answer, {sql_choice('answer', 'BUILDING')} AS choice FROM answers""",
)
def prediction_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = F.col("output")
    return customers(spark, sf_dir).select(
        "c_custkey",
        postprocess(output).alias("whole"),
        postprocess(output, delimiters=THINK, strip_reasoning=True).alias("answer"),
        postprocess(output, SEGMENTS, "BUILDING", THINK, strip_reasoning=True).alias("choice"),
    )


@query(
    "choice_extract",
    f"""SELECT c_custkey, {sql_choice('output', 'AUTOMOBILE')} AS choice,
        {sql_choice("'choice ' || output", 'HOUSEHOLD')} AS announced FROM {CUSTOMERS}""",
)
def choice_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    announced = F.concat(F.lit("choice "), F.col("output"))
    return customers(spark, sf_dir).select(
        "c_custkey",
        extract_choice(F.col("output"), SEGMENTS).alias("choice"),
        extract_choice(announced, SEGMENTS, "HOUSEHOLD").alias("announced"),
    )


@query(
    "label_normalize_pred",
    f"SELECT c_custkey, {sql_label('output')} AS prediction FROM {CUSTOMERS}",
)
def label_normalize_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = LabelMap.of(SEGMENTS)
    return customers(spark, sf_dir).select(
        "c_custkey", prediction_id(F.col("output"), labels).alias("prediction")
    )


@query(
    "label_normalize_ref",
    """SELECT c_custkey, CAST(list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS BIGINT) AS by_text,
        CAST(CASE WHEN c_nationkey < 5 THEN c_nationkey ELSE -1 END AS BIGINT) AS by_id,
        CASE WHEN trunc(c_acctbal / 100) BETWEEN 0 AND 4 THEN CAST(trunc(c_acctbal / 100) AS BIGINT) ELSE -1 END AS by_number
    FROM customer""",
)
def label_normalize_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The map in the other direction gives the same ids.
    labels = LabelMap.of({segment: i for i, segment in enumerate(SEGMENTS)})
    df = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(F.lit("  "), F.initcap("c_mktsegment"), F.lit("\n")).alias("by_text"),
        F.col("c_nationkey").alias("by_id"),
        (F.col("c_acctbal") / 100).alias("by_number"),
    )
    ids = [
        reference_id(F.col(c), df.schema[c].dataType, labels).alias(c)
        for c in ("by_text", "by_id", "by_number")
    ]
    return df.select("c_custkey", *ids)


@query(
    "constrained_valid_rate",
    f"""SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS n,
        round(avg(CASE WHEN regexp_full_match({sql_strip('output')}, '(0|1|2|3|4)') THEN 1 ELSE 0 END), 6) AS valid_rate
    FROM {CUSTOMERS} GROUP BY c_nationkey""",
)
def constrained_valid_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = is_constrained(postprocess(F.col("output")), ["0", "1", "2", "3", "4"])
    return (
        customers(spark, sf_dir)
        .groupBy(F.col("c_nationkey").cast("long").alias("nation"))
        .agg(F.count("*").alias("n"), F.round(F.avg(valid.cast("int")), 6).alias("valid_rate"))
    )


@query(
    "two_phase_compose",
    """SELECT c_custkey, c_name || chr(10) || '<think' AS first_prompt,
        c_name || chr(10) || '<think' || c_mktsegment || chr(10) || '</think' || chr(10) || '<answer>' AS answer_prompt,
        '<think' || c_mktsegment || chr(10) || '</think' || chr(10) || '<answer>' || 'yes' AS raw
    FROM customer""",
)
def two_phase_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt, thinking = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        thinking_prompt(prompt).alias("first_prompt"),
        answer_prompt(prompt, thinking).alias("answer_prompt"),
        F.concat(reasoning_part(thinking), F.lit("yes")).alias("raw"),
    )


# Model paths made from page addresses, with the flag set for some.
_PATH = "url || CASE page_id % 3 WHEN 0 THEN '/Some-Thinking-2B' WHEN 1 THEN '/REASONING' ELSE '/base' END"
_FLAG = "CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false END"


@query(
    "model_flags",
    f"""SELECT page_id, coalesce({_FLAG}, contains(lower({_PATH}), 'thinking') OR contains(lower({_PATH}), 'reasoning')) AS is_reasoning
    FROM pages""",
)
def model_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = is_reasoning_model(F.expr(_FLAG), F.expr(_PATH))
    return table(spark, sf_dir, "pages").select("page_id", flag.alias("is_reasoning"))


@query(
    "detail_examples",
    f"""WITH parts AS (
        SELECT c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS task, output, {sql_thinking('output')},
            row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM {CUSTOMERS})
    SELECT 'm' AS model, task, c_custkey AS index, c_name AS prompt, c_name || output AS prediction_raw,
        {sql_strip('output')} AS prediction_parsed, {sql_label(sql_strip('output'))} AS prediction,
        c_name || output AS prediction_with_prompt,
        CASE WHEN marked THEN {sql_strip('body')} END AS prediction_thinking,
        CASE WHEN marked THEN {sql_strip('after')} ELSE output END AS prediction_answer,
        c_mktsegment AS actual_raw, {sql_label('c_mktsegment')} AS actual
    FROM parts WHERE rn <= 20""",
)
def detail_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = LabelMap.of(SEGMENTS)
    df = customers(spark, sf_dir)
    parsed = postprocess(F.col("output"))
    scored = df.select(
        F.lit("m").alias("model"),
        F.col("c_nationkey").cast("string").alias("task"),
        F.col("c_custkey").alias("idx"),
        F.col("c_name").alias("prompt"),
        F.concat("c_name", "output").alias("prediction_raw"),
        F.col("output").alias("completion"),
        parsed.alias("prediction_parsed"),
        prediction_id(parsed, labels).alias("prediction"),
        F.col("c_mktsegment").alias("actual_raw"),
        reference_id(F.col("c_mktsegment"), df.schema["c_mktsegment"].dataType, labels).alias("actual"),
    )
    return detail_rows(scored, THINK, limit=20).drop("extra")


@query(
    "run_keys",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') AS run_id,
        replace(replace(o_orderpriority || '/' || o_orderstatus, '/', '_'), ' ', '_') AS model_key FROM orders""",
)
def run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        run_id(F.col("o_orderdate")).alias("run_id"),
        output_key(F.concat_ws("/", "o_orderpriority", "o_orderstatus")).alias("model_key"),
    )


@query(
    "completion_split",
    """SELECT u.conv_id, u.turn, a.text AS completion, u.text || a.text AS raw
    FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1""",
)
def completion_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    raw = F.concat("text", "next")
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", completion_of(raw, F.col("text")).alias("completion"), raw.alias("raw")
    )
