"""Exact inner-product top-k between two tables of vectors, and context assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.templates import render_values
from assayer.operators.block_search import CHUNK_ROWS, SCORE_DIGITS, BlockSearch
from assayer.operators.embedding import hashed_parts, keyed_texts, sparse_hashed
from assayer.operators.joins import join_spread
from assayer.operators.sparse_search import from_table, searching, stored_parts
from assayer.session import broadcast_if_small, materialize

# The query side goes to every task only up to so many bytes of vectors.
BROADCAST_BYTES = 8 * 1024 * 1024

# Bytes of the ids that go to every task so that only texts with a hit move.
ID_BYTES = 8 * 1024 * 1024

# Numbers of the queries that meet the corpus in one scan of it when both sides are large (32 MB).
GROUP_NUMBERS = 4 * 1024 * 1024

# Scans of the corpus for groups of a size that is asked for; with more, groups grow as far as the line above lets them.
SCANS = 16

# Vectors of the corpus that give the first lower bounds of what a hit must reach, at most.
SAMPLE_ROWS = 100_000

# Columns of one score matrix, which bounds its memory.
_SCORE_COLUMNS = 4_096
_SCORE_ROWS = 1_024

HIT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)

_PARTIAL = "query_id long, corpus_id long, score double"


def top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    vector: str = "embedding",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int | None = None,
    checked: bool = False,
    stored: bool = False,
) -> DataFrame:
    """The ``k`` corpus rows with the highest inner product for every query.

    ``queries`` has ``query_id``, ``corpus`` has ``corpus_id`` (both unique), both have
    ``vector``. Returns ``query_id, corpus_id, score, rank``; equal scores rank by id. An
    empty corpus is an error, unless the caller has ``checked`` it.

    Query vectors are written first, so that a model that makes them runs once. A query
    side of at most ``broadcast_bytes`` goes to every task, and the corpus is scanned where
    it lies, once. A larger one goes in groups of bounded size, each with a scan of its own, in
    which query blocks visit the corpus in the order of upper bounds (see
    :mod:`assayer.operators.block_search`; ``block_rows`` is the size of a group, as long as no more than ``SCANS`` come of it). The corpus is
    never shuffled; unless it is ``stored`` already it is written as it lies, so that a model that
    makes it runs once. A task keeps only its own best ``k`` per query; pairs are never written.
    Vectors must not be null and must have one length on both sides.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if not checked and corpus.isEmpty():
        raise ValueError("The corpus is empty")
    raw = F.col(vector).cast("array<double>")
    queries = materialize(queries.select(F.col("query_id").cast("long"), raw.alias("v")), "queries")
    size = queries.agg(F.count("*").alias("rows"), F.max(F.size("v")).alias("width")).first()
    width = max(size["width"] or 0, 1)
    values = _checked(F.col("v"), "query_id", width)
    queries = queries.select("query_id", values.alias("v"))
    corpus = corpus.select(F.col("corpus_id").cast("long"), raw.alias("v"))
    corpus = corpus.select("corpus_id", _checked(F.col("v"), "corpus_id", width if size["rows"] else None).alias("v"))
    if size["rows"] * width * 8 <= broadcast_bytes:
        partial = _scan(queries.toArrow(), corpus, k)
    else:
        most = max(GROUP_NUMBERS // width, 1)
        # Groups of a fixed size would be scans without end on a large query side.
        rows = max(block_rows, min(-(-size["rows"] // SCANS), most)) if block_rows else most
        partial = _by_bounds(queries, corpus if stored else materialize(corpus, "corpus"), k, rows, size["rows"])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    return (
        partial.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "corpus_id", "score", "rank")
    )


def _checked(vector: Column, key: str, width: int | None) -> Column:
    """The vector, or an error that names the row if it is null or of another length."""
    wrong = vector.isNull() if width is None else vector.isNull() | (F.size(vector) != width)
    message = F.concat(F.lit(f"The vector is null or not of length {width}: {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.when(wrong, F.raise_error(message).cast("array<double>")).otherwise(vector)


def _scan(queries: pa.Table, corpus: DataFrame, k: int) -> DataFrame:
    ids, vectors = _matrix(queries)
    shared = corpus.sparkSession.sparkContext.broadcast((ids, vectors))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_vectors = shared.value
        best = _Best(len(query_ids), k)
        for batch in batches:
            best.add(query_vectors, *_matrix(pa.Table.from_batches([batch])))
        yield from best.table(query_ids).to_batches()

    return corpus.mapInArrow(scan, _PARTIAL)


def _by_bounds(queries: DataFrame, corpus: DataFrame, k: int, group_rows: int, n_queries: int) -> DataFrame:
    """The candidates of all query groups, each from a scan of the corpus; written group by group.

    Before the scan a group is scored against a sample of the corpus: what its k-th best hit reaches
    there, the k-th best of all reaches as well, so tasks send little that is not a hit.
    """
    spark = queries.sparkSession
    n_groups = -(-n_queries // group_rows)
    grouped = queries.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(n_groups)))
    rate = min(SAMPLE_ROWS / max(corpus.count(), 1), 0.05)
    chosen = corpus.where(F.pmod(F.xxhash64(F.col("corpus_id"), F.lit(1)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    sample = materialize(chosen, "corpus-sample").coalesce(8)
    found = []
    for group in range(n_groups):
        ids, vectors = _matrix(grouped.where(F.col("group") == group).select("query_id", "v").toArrow())
        if not len(ids):
            continue
        first = sample.mapInArrow(_search(spark, ids, vectors, k, np.full(len(ids), -np.inf)), _PARTIAL)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        known = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", "score").toArrow()
        least = np.full(len(ids), -np.inf)
        least[np.searchsorted(ids, known.column("query_id").to_numpy())] = known.column("score").to_numpy()
        found.append(materialize(corpus.mapInArrow(_search(spark, ids, vectors, k, least), _PARTIAL), "candidates"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _PARTIAL)


def _search(
    spark: SparkSession, ids: np.ndarray, vectors: np.ndarray, k: int, known: np.ndarray
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    shared = spark.sparkContext.broadcast((ids, vectors, known))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_vectors, least = shared.value
        best = BlockSearch(query_vectors, k, least)
        for part in chunks(batches):
            best.add(*_matrix(part))
        row, hits, scores = best.hits()
        found = pa.table({"query_id": query_ids[row].astype(np.int64), "corpus_id": hits, "score": scores})
        yield from found.to_batches()

    return search


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Batches put together into tables of at least ``rows`` rows; the last one is as it is."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) >= rows:
            yield pa.Table.from_batches(waiting)
            waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting)


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of an Arrow table, sorted by id."""
    ids = table.column(0).to_numpy()
    if not len(ids):
        return ids, np.zeros((0, 0))
    flat = table.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


class _Best:
    """The best ``k`` of what a task has scored so far, for each of its queries."""

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.scores = np.full((n_queries, 0), 0.0)
        self.ids = np.full((n_queries, 0), 0, dtype=np.int64)

    def add(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), _SCORE_COLUMNS):
            part = slice(at, at + _SCORE_COLUMNS)
            rows = [
                self._merged(slice(q, q + _SCORE_ROWS), queries, ids[part], vectors[part])
                for q in range(0, len(queries), _SCORE_ROWS)
            ]
            if rows:
                self.scores = np.vstack([scores for scores, _ in rows])
                self.ids = np.vstack([best for _, best in rows])

    def _merged(self, rows: slice, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        known, best = self.scores[rows], self.ids[rows]
        scores = queries[rows] @ vectors.T
        if known.shape[1] == self.k:
            # Few of the new scores reach the lowest of the best so far.
            row, column = np.nonzero(scores >= known[:, -1:] - 2 * 10.0**-SCORE_DIGITS)
            if len(row) <= known.size:
                found = np.round(scores[row, column], SCORE_DIGITS)
                return _with_few(known, best, row, found, ids[column])
        scores = np.round(scores, SCORE_DIGITS)
        kept = _top_columns(scores, self.k)
        scores = np.hstack([known, np.take_along_axis(scores, kept, axis=1)])
        best = np.hstack([best, ids[kept]])
        order = np.lexsort((best, -scores), axis=1)[:, : self.k]
        return np.take_along_axis(scores, order, axis=1), np.take_along_axis(best, order, axis=1)

    def table(self, query_ids: np.ndarray) -> pa.Table:
        width = self.ids.shape[1]
        return pa.table(
            {
                "query_id": np.repeat(query_ids, width).astype(np.int64),
                "corpus_id": self.ids.ravel(),
                "score": self.scores.ravel(),
            }
        )


def _with_few(known: np.ndarray, best: np.ndarray, row: np.ndarray, scores: np.ndarray, ids: np.ndarray):
    """Full rows of best scores and ids, after single candidates for some of the rows."""
    if not len(row):
        return known, best
    height, k = known.shape
    rows = np.concatenate([np.repeat(np.arange(height), k), row])
    scores = np.concatenate([known.ravel(), scores])
    ids = np.concatenate([best.ravel(), ids])
    order = np.lexsort((ids, -scores, rows))
    starts = np.searchsorted(rows[order], np.arange(height))
    kept = order[starts[:, None] + np.arange(k)]
    return scores[kept], ids[kept]


def _top_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` highest scores per row; equal scores favour the left column."""
    width = scores.shape[1]
    if width <= k:
        return np.tile(np.arange(width), (len(scores), 1))
    # A whole number that orders by score, then by column, has no ties to break.
    scale = 10.0**SCORE_DIGITS
    if np.abs(scores).max(initial=0.0) * scale * width < 2**62:
        key = np.arange(width) - np.rint(scores * scale).astype(np.int64) * width
        return np.argpartition(key, k - 1, axis=1)[:, :k]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def fetch_text(
    hits: DataFrame, corpus: DataFrame, text: str = "text", stored: bool = False
) -> DataFrame:
    """Join the texts of the retrieved ids, once only the best hits are left.

    Hits that are not ``stored`` yet are, so the corpus is not scored again. The ids that
    were hit go to where the corpus lies (``ID_BYTES`` of them at most) and only their texts
    move; more ids than that are joined by key. A document that a large share of the queries
    hit is spread over several tasks.
    """
    texts = corpus.select("corpus_id", F.col(text).alias("text"))
    hits = hits if stored else materialize(hits, "hits")
    wanted = materialize(hits.select("corpus_id").distinct(), "hit-ids")
    wanted = broadcast_if_small(wanted, ID_BYTES // 8)
    return join_spread(hits, texts.join(wanted, "corpus_id", "left_semi"), "corpus_id", "query_id")


def gather_hits(hits: DataFrame) -> DataFrame:
    """One row per query with its hits in rank order; a query has at most ``k`` of them."""
    hit = F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("corpus_id").alias("id"), "score", "text"
    )
    ranked = F.sort_array(F.collect_list(hit))
    in_layout = F.transform(
        ranked,
        lambda h: F.struct(h["id"].alias("id"), h["rank"].alias("rank"), h["score"].alias("score"), h["text"].alias("text")),
    )
    return hits.groupBy("query_id").agg(in_layout.alias("results"))


def format_context(results: Column, template: str = "{text}", separator: str = "\n\n") -> Column:
    """Each hit rendered with ``template``, joined in rank order; no hits give ''."""

    def one(hit: Column) -> Column:
        return render_values(template, {f.name: (hit[f.name], f.dataType) for f in HIT})

    return F.coalesce(F.array_join(F.transform(results, one), separator), F.lit(""))


def with_context(
    queries: DataFrame, hits: DataFrame, template: str = "{text}", separator: str = "\n\n"
) -> DataFrame:
    """Add ``results`` and ``context`` to every query, also to those without hits."""
    joined = queries.join(gather_hits(hits), "query_id", "left")
    none = F.array().cast(T.ArrayType(HIT))
    return joined.withColumn("results", F.coalesce("results", none)).withColumn(
        "context", format_context(F.col("results"), template, separator)
    )


def top_k_text(
    queries: DataFrame, corpus: DataFrame, k: int, dim: int = 256, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Lexical top-k without a model: hashed token counts on both sides, as for :func:`top_k`.

    Texts without tokens, blank queries among them, have no hits. Only the terms of a text are kept, and a
    task searches its part of the corpus through postings (see :mod:`assayer.operators.sparse_search`).
    Queries go to every task, in groups of at most ``broadcast_bytes``. One group is searched where texts are
    read, so texts and terms share a Python worker; with more, the corpus's terms are written first, and read
    where they lie.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if corpus.isEmpty():
        raise ValueError("The corpus is empty")
    spark = corpus.sparkSession
    asked = materialize(sparse_hashed(queries, "query_id", text, dim), "queries")
    numbers = asked.agg(F.sum(F.size("terms") + 2)).first()[0] or 0
    n_groups = max(-(-numbers * 16 // max(broadcast_bytes, 1)), 1)
    if n_groups == 1:
        documents, read = keyed_texts(corpus, "corpus_id", text), partial(hashed_parts, dim=dim)
    else:
        documents, read = materialize(sparse_hashed(corpus, "corpus_id", text, dim), "corpus-terms"), stored_parts
    grouped = asked.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(n_groups)))
    found = []
    for group in range(n_groups):
        terms = grouped.where(F.col("group") == group).drop("group").toArrow()
        if terms.num_rows or not group:
            shared = spark.sparkContext.broadcast(from_table(terms))
            hits = documents.mapInArrow(searching(lambda shared=shared: shared.value, k, read), _PARTIAL)
            found.append(hits if n_groups == 1 else materialize(hits, "candidates"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "corpus_id", "score", "rank")
