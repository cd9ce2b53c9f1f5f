"""Text embeddings: pooling of token vectors, plug-in encoders, hashed token counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.text import text_steps, token_codes
from assayer.functions.vectors import as_doubles, l2_normalize
from assayer.operators.sparse_search import Sparse, to_batch, unit_counts

Encoder = Callable[[list[str]], np.ndarray]

_SMALLEST_COUNT = 1e-9

# Numbers that the sums of a task may hold before they are sent.
_HELD_NUMBERS = 1 << 22

# Tokens whose bucket a task remembers, and rows that become vectors at a time.
_KNOWN_TOKENS, _VECTOR_ROWS = 1 << 18, 1_024


def mean_pool(tokens: DataFrame, key: str, vector: str, mask: Column) -> DataFrame:
    """Masked mean of token vectors per ``key``, unit length: ``(key, embedding)``.

    Every task adds up whole vectors, so it sends one row per key that it met, whatever the number
    of tokens and of dimensions; a key with very many tokens costs no more than the others.
    """
    weighted = tokens.select(F.col(key), mask.cast("double").alias("weight"), as_doubles(F.col(vector)).alias("vector"))
    kind = weighted.schema[key].dataType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("weight", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType()))
    ])
    partial = weighted.mapInArrow(_sums(False), schema)
    sums = partial.repartition(key).sortWithinPartitions(key).mapInArrow(_sums(True), schema)
    mean = F.transform(F.col("vector"), lambda x: x / F.greatest(F.col("weight"), F.lit(_SMALLEST_COUNT)))
    return sums.select(key, mean.alias("_pooled")).select(key, l2_normalize(F.col("_pooled")).alias("embedding"))


def _sums(ordered: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per key the sums of weights and of weighted vectors.

    Rows in the order of their keys leave one row per key. Otherwise a task gives away its sums whenever they
    take much room. Vectors that are sums already are added as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, list] = {}

        def given(keys: list, schema: pa.Schema) -> pa.RecordBatch:
            found = [sums.pop(k) for k in keys]
            columns = [keys, [w for w, _ in found], [v for _, v in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            for name, weight, total in _batch_sums(batch, weighted=not ordered):
                if name not in sums:
                    sums[name] = [weight, total]
                elif len(sums[name][1]) == len(total):
                    sums[name] = [sums[name][0] + weight, sums[name][1] + total]
                else:
                    raise ValueError(f"Vectors of different lengths for {name}")
            numbers = sum(len(v) for _, v in sums.values())
            if ordered and len(batch):
                last = batch.column(0)[-1].as_py()
                yield given([k for k in sums if k != last], schema)
            elif numbers > _HELD_NUMBERS:
                yield given(list(sums), schema)
        if sums:
            yield given(list(sums), schema)

    return run


def _batch_sums(batch: pa.RecordBatch, weighted: bool) -> Iterator[tuple[object, float, np.ndarray]]:
    coded = batch.column(0).dictionary_encode()
    codes = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
    names = [*coded.dictionary.to_pylist(), None]
    weights = pc.fill_null(batch.column(1), 0.0).to_numpy(zero_copy_only=False)
    for width, rows in _by_width(batch.column(2)):
        flat = pc.fill_null(batch.column(2).take(pa.array(rows)).flatten(), 0.0)
        flat = flat.to_numpy(zero_copy_only=False).reshape(len(rows), width)
        used, index = np.unique(codes[rows], return_inverse=True)
        totals = np.zeros((len(used), width))
        np.add.at(totals, index, flat * weights[rows, None] if weighted else flat)
        for code, weight, total in zip(used, np.bincount(index, weights[rows]), totals):
            yield names[code], float(weight), total


def _by_width(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Rows that are neither null nor empty, by the length of their vectors."""
    widths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for width in np.unique(widths[widths > 0]):
        yield int(width), np.flatnonzero(widths == width)


def first_token_pool(tokens: DataFrame, key: str, position: str, vector: str) -> DataFrame:
    """The vector of the first token per ``key``, unit length."""
    firsts = tokens.groupBy(key).agg(F.min_by(F.col(vector), F.col(position)).alias("_first"))
    return firsts.select(key, l2_normalize(F.col("_first")).alias("embedding"))


def embed_with(df: DataFrame, text: str, load: Callable[[], Encoder], batch_size: int = 32) -> DataFrame:
    """Add ``embedding`` from a plug-in encoder, loaded once per Python worker.

    ``load`` returns a function from a list of texts to a float matrix. Only the text
    column crosses to Python. The call counts as nondeterministic, so that no rewrite of
    the plan runs the encoder twice.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            rows = texts.tolist()
            vectors = [
                v
                for at in range(0, len(rows), batch_size)
                for v in _unit(encoder(rows[at : at + batch_size]))
            ]
            yield pd.Series(vectors, dtype=object)

    return df.withColumn("embedding", encode.asNondeterministic()(F.col(text)))


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay zero."""
    matrix = np.asarray(matrix, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.maximum(norms, 1e-12)


def embed_hashed(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """A model-free embedding: unit-length hashed token counts, ``(key, embedding)``.

    Texts without any token have no row. A row needs only its own text, so nothing is
    shuffled; a token's bucket is the first 32 bits of its MD5 modulo ``dim``.
    """

    @F.arrow_udf("array<double>")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = _Buckets(dim)
        for texts in batches:
            texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
            # A few rows at a time, as each has many tokens and becomes a vector.
            for first, last in text_steps(texts, _VECTOR_ROWS):
                n = last - first
                rows, bucket = buckets.of(texts.slice(first, n))
                matrix = np.bincount(rows * dim + bucket, minlength=n * dim).reshape(n, dim)
                yield _vectors(_unit(matrix), matrix.any(axis=1))

    # As nondeterministic, it is not run once more for the filter.
    embedded = df.select(key, counts.asNondeterministic()(F.lower(F.col(text))).alias("embedding"))
    return embedded.where(F.col("embedding").isNotNull())


def sparse_hashed(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """As :func:`embed_hashed`, but only the terms that a text has: ``(key, terms, weights)``, terms in order."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in hashed_parts(batches, dim):
            yield to_batch(part, (key, "terms", "weights"))

    return keyed_texts(df, key, text).mapInArrow(counts, f"`{key}` long, terms array<long>, weights array<double>")


def keyed_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """What :func:`hashed_parts` reads."""
    return df.select(F.col(key).cast("long").alias(key), F.lower(F.col(text)).alias("text"))


def hashed_parts(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[Sparse]:
    """The terms of the texts in batches of (key, lower-cased text), a few texts at a time."""
    buckets = _Buckets(dim)
    for batch in batches:
        for first, last in text_steps(batch.column(1), _VECTOR_ROWS):
            part = batch.slice(first, last - first)
            rows, bucket = buckets.of(part.column(1))
            yield unit_counts(part.column(0).to_numpy(zero_copy_only=False), rows, bucket, dim)


class _Buckets:
    """The buckets of tokens, worked out once for each token of a batch and remembered for a while."""

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.known: dict[str, int] = {}

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all tokens and their buckets."""
        rows, codes, names = token_codes(texts)
        for name in names:
            if name not in self.known:
                self.known[name] = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % self.dim
        bucket = np.array([self.known[name] for name in names] or [0], np.int64)[codes]
        if len(self.known) > _KNOWN_TOKENS:
            self.known.clear()
        return rows, bucket


def _vectors(matrix: np.ndarray, known: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists, null where they are not ``known``."""
    offsets = np.concatenate([[0], np.cumsum(np.where(known, matrix.shape[1], 0))]).astype(np.int32)
    values = pa.array(matrix[known].ravel(), pa.float64())
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(~known))


def _in_order(position: str, value: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(position, value))).getField(value)
