"""Sources: datasets by split, custom loaders, files, JSON lines, binary documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping
from functools import reduce
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow.dataset import dataset
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.naming import output_key
from assayer.operators.chunking import fixed_chunks, recursive_chunks, register_chunker
from assayer.operators.results import unpivot_metrics
from assayer.queries.registry import FRAME, past_results, query, sql_strip, table
from assayer.session import new_path
from assayer.sources import datasets, files, runs

LANGUAGES = ("en", "de", "fr", "es")


@query(
    "scan_split",
    "SELECT lang AS split, doc_id, n_chars FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')",
)
def scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "split")
    documents = table(spark, sf_dir, "documents").withColumnRenamed("lang", "split")
    documents.write.partitionBy("split").parquet(path)
    parts = [datasets.load(spark, {"path": path, "split": lang}) for lang in LANGUAGES]
    return reduce(DataFrame.unionByName, parts).select("split", "doc_id", "n_chars")


def labelled_documents(config: Mapping) -> DataFrame:
    """A custom loader, named by its dotted path in the query below."""
    spark = SparkSession.active()
    documents = table(spark, config["dir"], "documents")
    return documents.join(table(spark, config["dir"], "labels"), "doc_id")


@query(
    "scan_custom_source",
    """SELECT d.doc_id, d.lang, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic
    FROM documents d JOIN labels l USING (doc_id)""",
)
def scan_custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    loader = f"{__name__}.labelled_documents"
    rows = datasets.load(spark, {"type": "custom", "loader": loader, "dir": sf_dir})
    return rows.select(
        "doc_id", "lang", F.col("quality").cast("long"), F.col("toxic").cast("long")
    )


class DocumentShards:
    """A loader of four shards that tasks read; the source is told of French documents alone."""

    def __init__(self, config: Mapping) -> None:
        self.path = f"{config['dir']}/documents.parquet"

    def shards(self) -> list[int]:
        return list(range(4))

    def rows(self, shard: int) -> Iterator[dict]:
        for number, batch in enumerate(dataset(self.path).to_batches(columns=["doc_id", "lang", "source", "n_chars"], batch_size=64)):
            if number % 4 == shard:
                for row in batch.to_pylist():
                    told = {"source": row["source"]} if row["lang"] == "fr" else {}
                    yield {"doc_id": row["doc_id"], "size": {"chars": row["n_chars"]} if row["n_chars"] > 100 else None, **told}


@query(
    "scan_custom_shards",
    """SELECT doc_id, CASE WHEN lang = 'fr' THEN source END AS source, CASE WHEN n_chars > 100 THEN n_chars END AS chars FROM documents""",
)
def scan_custom_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of mixed shape, read by one task per shard."""
    rows = datasets.load(spark, {"type": "custom", "loader": f"{__name__}.DocumentShards", "dir": sf_dir})
    return rows.select("doc_id", "source", F.col("size.chars").alias("chars"))


def _write_items(spark: SparkSession, sf_dir: str) -> str:
    """One text file per benchmark item."""
    path = new_path(spark, "items")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("value"))
    _dealt(items, "item_id").write.partitionBy("item_id").text(path)
    return path


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows for a file per key: what counts is the number of files, so small tasks are not put together by their bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _item_id(path: str) -> F.Column:
    return F.regexp_extract(path, r"item_id=(\d+)/", 1).cast("long").alias("item_id")


@query("file_discovery", "SELECT item_id, '.txt' AS extension FROM benchmark")
def file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _write_items(spark, sf_dir)
    # The folder and a pattern over it name the same files.
    found = files.discover(spark, [path, f"{path}/*"], extensions=["TXT", ".md"])
    return found.select(_item_id("path"), "extension")


@query("text_file_scan", "SELECT item_id, text || chr(10) AS text FROM benchmark")
def text_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = files.read_texts(spark, [_write_items(spark, sf_dir)])
    return texts.select(_item_id("source"), "text")


@query(
    "jsonl_scan",
    """SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_number
    FROM conversations""",
)
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per conversation, with blank lines after every question."""
    path = new_path(spark, "jsonl")
    line = F.to_json(F.struct(F.struct(F.col("text").alias("body")).alias("message"), "role"))
    blank = F.when(F.col("role") == "user", F.lit("\n  \n")).otherwise(F.lit(""))
    (
        _dealt(table(spark, sf_dir, "conversations"), "conv_id")
        .sortWithinPartitions("conv_id", "turn")
        .select("conv_id", F.concat(line, blank).alias("value"))
        .write.partitionBy("conv_id")
        .text(path)
    )
    lines = files.read_jsonl(spark, [path], content="message.body", extensions=[".txt"])
    conv_id = F.regexp_extract("source", r"conv_id=(\d+)/", 1).cast("long")
    return lines.select(conv_id.alias("conv_id"), "text", "line_number")


@query("json_path_extract", "SELECT event_id, props ->> '$.k' AS k FROM events")
def json_path_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", files.json_content(F.col("props"), "k", strict=False).alias("k"))


def _docx(text: str) -> bytes:
    """A minimal word-processor file with one paragraph per line."""
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    paragraphs = "".join(f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>" for t in text.split("\n"))
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as archive:
        archive.writestr(
            "word/document.xml",
            f'<w:document xmlns:w="{word}"><w:body>{paragraphs}</w:body></w:document>',
        )
    return content.getvalue()


@query(
    "binary_doc_extract",
    f"SELECT doc_id, {sql_strip('replace(text, chr(10), chr(10) || chr(10))')} AS text FROM documents",
)
def binary_doc_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(_docx)

    packed = table(spark, sf_dir, "documents").select("doc_id", pack("text").alias("content"))
    return files.extract_texts(packed, files.docx_text)


@query(
    "chunk_metadata",
    """WITH chunks AS (
        SELECT 'conv-' || conv_id AS source_path, turn + 1 AS line_number, text, unnest(range(0, length(text), 80)) AS chunk_start
        FROM conversations)
    SELECT source_path, line_number, chunk_start, least(chunk_start + 100, length(text)) AS chunk_end,
        substr(text, chunk_start + 1, 100) AS text,
        row_number() OVER (PARTITION BY source_path ORDER BY line_number, chunk_start) - 1 AS chunk_index
    FROM chunks""",
)
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    docs = table(spark, sf_dir, "conversations").select(
        source.alias("source"), (F.col("turn") + 1).alias("line_number"), "text"
    )
    chunks = fixed_chunks(docs, "text", 100, 20).select(
        "source", "line_number", F.col("chunk").alias("text"), F.col("chunk_start").alias("start_index"), F.col("chunk_index").alias("_piece")
    )
    return files.normalize_metadata(chunks, number_chunks=True).select(
        "source_path", "line_number", "chunk_start", F.col("chunk_end").cast("long"), "text", "chunk_index"
    )


@query(
    "chunk_fixed",
    """WITH starts AS (SELECT doc_id, text, unnest(range(0, length(text), 350)) AS chunk_start FROM documents)
    SELECT doc_id, substr(text, chunk_start + 1, 400) AS chunk, chunk_start,
        least(chunk_start + 400, length(text)) AS chunk_end, chunk_start // 350 AS chunk_index
    FROM starts""",
)
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fixed_chunks(documents, "text", 400, 50).drop("text")


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recursive_chunks(documents, "text", 400, 50).drop("text")


@query("chunk_lateral")
def chunk_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recursive splitter as a table function in SQL."""
    register_chunker(spark, "chunk_text")
    return spark.sql(
        "SELECT d.doc_id, c.* FROM {documents} d, LATERAL chunk_text(d.text, 400, 50) c",
        documents=table(spark, sf_dir, "documents"),
    )


@query(
    "run_results_scan",
    f"""SELECT run_id, model, task, metric_name, round(avg(metric_value), 6) AS metric_value,
        count(*) AS num_examples
    FROM {FRAME} GROUP BY ALL""",
)
def run_results_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task files for every run, and for two of them a summary that takes precedence."""
    path = new_path(spark, "runs")
    results = (
        unpivot_metrics(past_results(spark, sf_dir))
        .groupBy("run_id", "model", "task", "metric_name")
        .agg(F.avg("metric_value").alias("v"), F.count("*").alias("num_examples"))
        .groupBy("run_id", "model", "task", "num_examples")
        .agg(F.map_from_entries(F.collect_list(F.struct("metric_name", "v"))).alias("metrics"))
    )
    run = F.struct("model", "task", "metrics", "num_examples")
    folder = output_key(F.col("model")).alias("model_key")
    tasks = results.groupBy("run_id", folder).agg(F.collect_list(run).alias("runs"))
    tasks.write.partitionBy("run_id", "model_key").json(path)
    for run_id in ("1996", "1997"):
        one = results.where(F.col("run_id") == run_id)
        summary = one.groupBy().agg(F.collect_list(run).alias("runs"))
        summary.coalesce(1).write.json(f"{path}/run_id={run_id}/summary.json")
    frame = runs.read_run_frame(spark, [path])
    return frame.withColumn("metric_value", F.round("metric_value", 6))
