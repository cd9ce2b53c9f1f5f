"""The table of queries, and inputs that several of them share."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.text import WHITESPACE

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (
    "scans", "scalars", "selection", "retrieving", "embedding", "inferring", "scoring",
    "comparing", "storing", "streams",
)

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is left out where SQL cannot express it."""

    def add(fn: Query) -> Query:
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"assayer.queries.{module}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Expressions that read the same in Spark SQL and in the checking SQL ---

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

# Model output made from a customer, so that every branch of post-processing occurs.
OUTPUT = """CASE c_custkey % 9
    WHEN 0 THEN '<think>maybe ' || c_name || '</think> <answer> ' || lower(c_mktsegment) || ' </answer>'
    WHEN 1 THEN 'I would say ' || c_mktsegment || '  ' || chr(10)
    WHEN 2 THEN 'The option: ' || lower(c_mktsegment) || ' looks right, given ' || c_name
    WHEN 3 THEN c_name || ' works in ' || c_mktsegment || ' mostly'
    WHEN 4 THEN ' ' || CAST(c_nationkey % 5 AS STRING) || ' '
    WHEN 5 THEN '<think>first BUILDING</think> then </think> choice = ' || c_mktsegment || '!'
    WHEN 6 THEN ''
    WHEN 7 THEN 'no idea about ' || c_name || chr(10)
    ELSE '</think> ' || c_name || ' <think> ' || c_mktsegment END"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a classification task with a made-up model output."""
    return table(spark, sf_dir, "customer").withColumn("output", F.expr(OUTPUT))


CUSTOMERS = f"(SELECT *, {OUTPUT} AS output FROM customer)"

# Results of past runs: every order is the result of one model on one task.
RESULT_COLUMNS = """CAST(year(o_orderdate) AS STRING) AS run_id, o_orderpriority AS model,
    o_orderstatus AS task, o_totalprice / 1000000 AS price, o_custkey / 1000000 AS customer"""


def past_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", *_split_select(RESULT_COLUMNS)
    )
    metrics = F.create_map(F.lit("price"), F.col("price"), F.lit("customer"), F.col("customer"))
    return rows.select(
        "run_id", "model", "task", metrics.alias("metrics"), F.lit(1).cast("long").alias("num_examples")
    )


def _split_select(text: str) -> list[str]:
    return [part.strip() for part in text.split(",")]


FRAME = f"""(SELECT run_id, model, task, unnest(['price', 'customer']) AS metric_name,
    unnest([price, customer]) AS metric_value, 1 AS num_examples
    FROM (SELECT {RESULT_COLUMNS} FROM orders))"""

# A user turn, the assistant turn after it, and two stand-ins for model output.
DIALOGUE = """SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer,
    a.text || ' ' || u.text AS longer
    FROM {c} u JOIN {c} a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'"""


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIALOGUE.format(c="{t}"), t=table(spark, sf_dir, "conversations"))


# --- Pieces of checking SQL ---

SQL_WHITESPACE = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def sql_strip(text: str) -> str:
    return f"trim({text}, {SQL_WHITESPACE})"


def sql_choice(text: str, default: str) -> str:
    group = "|".join(SEGMENTS)
    places = (
        rf"(?i)<answer>\s*({group})\s*</answer>",
        rf"(?i)\b({group})\b\s*$",
        rf"(?i)(?:answer|choice|option)\s*(?:is)?\s*[:=]?\s*({group})",
    )
    found = ", ".join(f"nullif(regexp_extract({text}, '{p}', 1), '')" for p in places)
    return f"coalesce(upper(coalesce({found})), '{default}')"


def sql_label(text: str) -> str:
    exact = " ".join(f"WHEN l = '{s.lower()}' THEN {i}" for i, s in enumerate(SEGMENTS))
    inside = " ".join(f"WHEN contains(l, '{s.lower()}') THEN {i}" for i, s in enumerate(SEGMENTS))
    label = f"lower({sql_strip(text)})"
    body = rf"CASE {exact} {inside} WHEN regexp_full_match(l, '[+-]?\d+') THEN CAST(l AS BIGINT) ELSE -1 END"
    return body.replace(" l ", f" {label} ").replace("(l,", f"({label},").replace("CAST(l ", f"CAST({label} ")


def sql_thinking(text: str) -> str:
    """Columns ``before, body, after`` around the first <think> section, NULL without one."""
    rest = f"substr({text}, strpos({text}, '<think>') + 7)"
    end = f"strpos({rest}, '</think>')"
    return f"""contains({text}, '<think>') AND contains({text}, '</think>') AS marked,
        substr({text}, 1, strpos({text}, '<think>') - 1) AS before,
        CASE WHEN {end} > 0 THEN substr({rest}, 1, {end} - 1) ELSE {rest} END AS body,
        CASE WHEN {end} > 0 THEN substr({rest}, {end} + 8) ELSE '' END AS after"""


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)
