"""Prompts with retrieved context."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.templates import render
from assayer.functions.text import strip
from assayer.operators.embedding import embed_with
from assayer.operators.positions import with_file_position, with_position
from assayer.operators.retrieval import fetch_text, top_k, top_k_text, with_context
from assayer.plans.spec import RagSpec, SpecError, TaskSpec
from assayer.sources import datasets

# Where a file corpus has its rows in order.
_FILE_ORDER = ("source_path", "line_number", "page", "chunk_index")


def render_corpus(corpus: DataFrame, rag: RagSpec) -> DataFrame:
    """The corpus as ``corpus_id, text``."""
    if "corpus_id" not in corpus.columns:
        fields = {path.split(".")[0] for path in rag.corpus_mappings.values()}
        order = list(rag.corpus_order) or [c for c in _FILE_ORDER if c in corpus.columns]
        file, row = datasets.FILE_ORDER
        if order:
            corpus = with_position(corpus.select(*sorted(fields.union(order))), order, name="corpus_id")
        elif file in corpus.columns:
            corpus = corpus.select(*sorted(fields), file, row, datasets.FILE_SPLIT)
            corpus = with_file_position(corpus, file, datasets.FILE_SPLIT, row, name="corpus_id")
        else:
            raise SpecError("rag: the corpus needs a corpus_id column or a corpus_order")
    text = render(corpus.schema, rag.corpus_template, rag.corpus_mappings)
    return corpus.select("corpus_id", text.alias("text"))


def retrieve(queries: DataFrame, corpus: DataFrame, rag: RagSpec) -> DataFrame:
    """Hits with their texts for ``query_id, query`` rows; blank queries have none."""
    if corpus.isEmpty():
        raise ValueError("The corpus is empty")
    asked = queries.where(strip(F.col("query")) != "").select("query_id", F.col("query").alias("text"))
    if rag.embedder == "hashed":
        return fetch_text(top_k_text(asked, corpus, rag.context_k), corpus)
    left = embed_with(asked, "text", rag.embedder, rag.embed_batch_size)
    right = embed_with(corpus, "text", rag.embedder, rag.embed_batch_size)
    return fetch_text(top_k(left, right, rag.context_k, checked=True), corpus)


def rag_prompts(examples: DataFrame, corpus: DataFrame, task: TaskSpec) -> DataFrame:
    """Adds ``prompt`` and ``extra`` to examples with ``idx`` and the dataset ``row``.

    ``corpus`` has ``corpus_id`` and ``text``. The corpus is embedded and scanned once for
    all queries.
    """
    rag = task.rag
    row, fields = F.col("row"), examples.schema["row"].dataType
    query = render(fields, task.query_template, task.query_mappings, root=row)
    queries = examples.withColumn("query", query).withColumnRenamed("idx", "query_id")
    hits = retrieve(queries.select("query_id", "query"), corpus, rag)
    found = with_context(queries, hits, rag.context_template, rag.context_separator)
    context = {"context": (F.col("context"), T.StringType())}
    prompt = render(fields, task.prompt_template, task.input_mappings, context, row)
    extra = F.struct(F.struct("query", "context", "results").alias("rag"))
    return (
        found.withColumns({"prompt": prompt, "extra": extra})
        .withColumnRenamed("query_id", "idx")
        .drop("query", "context", "results")
    )


def load_corpus(spark, rag: RagSpec) -> DataFrame:
    """The corpus with ids: its own, by ``corpus_order``, or the places of its rows in their files."""
    corpus = rag.corpus
    if isinstance(corpus, Mapping) and corpus.get("type") == "files":
        corpus = {**corpus, "include_metadata": True}  # for the order; only mapped fields are read
    return render_corpus(datasets.load(spark, corpus, rag.corpus_split, with_order=True), rag)
