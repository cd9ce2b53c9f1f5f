"""Splitting texts into chunks, one output row per chunk."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Where a text is cut, coarsest first; the last one cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")


def check_overlap(size: int, overlap: int) -> None:
    if size > 0 and overlap >= size:
        raise ValueError("The chunk overlap must be smaller than the chunk size")


def fixed_chunks(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Cut at a fixed stride; adds ``chunk, chunk_start, chunk_end, chunk_index``."""
    check_overlap(size, overlap)
    source = F.col(text)
    length = F.length(source)
    if size <= 0:
        return df.withColumns(
            {
                "chunk": source,
                "chunk_start": F.lit(0).cast("long"),
                "chunk_end": length.cast("long"),
                "chunk_index": F.lit(0).cast("long"),
            }
        )
    step = size - overlap
    starts = F.when(length > 0, F.sequence(F.lit(0), length - 1, F.lit(step)))
    cut = df.select("*", F.posexplode(starts).alias("_index", "_start"))
    return cut.select(
        *df.columns,
        F.substr(source, F.col("_start") + 1, F.lit(size)).alias("chunk"),
        F.col("_start").cast("long").alias("chunk_start"),
        F.least(F.col("_start") + size, length).cast("long").alias("chunk_end"),
        F.col("_index").cast("long").alias("chunk_index"),
    )


def recursive_chunks(df: DataFrame, text: str, size: int | None, overlap: int = 0) -> DataFrame:
    """Cut at paragraphs, lines and words; adds ``chunk, chunk_start, chunk_end, chunk_index``.

    Only the text column crosses to Python, and no rows are shuffled. Without a positive
    size the whole text is the one chunk.
    """
    if not size or size <= 0:
        return fixed_chunks(df, text, 0, 0)
    check_overlap(size, overlap)

    @F.pandas_udf("text array<string>, start array<bigint>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            cuts = [split_text(t or "", size, overlap) for t in texts]
            yield pd.DataFrame(
                {
                    "text": [[chunk for _, chunk in cut] for cut in cuts],
                    "start": [[start for start, _ in cut] for cut in cuts],
                }
            )

    # Nondeterministic, so that no rewrite of the plan cuts a text twice.
    pieces = pieces.asNondeterministic()
    found = df.withColumn("_found", pieces(F.col(text)))
    cut = found.select(
        *df.columns, F.posexplode(F.arrays_zip("_found.text", "_found.start")).alias("_index", "_piece")
    )
    start = F.col("_piece.start")
    return cut.select(
        *df.columns,
        F.col("_piece.text").alias("chunk"),
        start.alias("chunk_start"),
        (start + F.length("_piece.text")).alias("chunk_end"),
        F.col("_index").cast("long").alias("chunk_index"),
    )


def register_chunker(spark: SparkSession, name: str = "chunk_text") -> None:
    """Make the recursive splitter callable from SQL: ``LATERAL chunk_text(text, 400, 40)``."""

    @F.udtf(returnType="chunk string, chunk_start bigint, chunk_index bigint", useArrow=True)
    class Chunker:
        def eval(self, text: str, size: int, overlap: int):
            check_overlap(size, overlap)
            for index, (start, chunk) in enumerate(split_text(text or "", size, overlap)):
                yield chunk, start, index

    spark.udtf.register(name, Chunker)


def split_text(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Chunks of one text with their start offsets."""
    found: list[tuple[int, str]] = []
    at = previous = 0
    for chunk in _cut(text, SEPARATORS, size, overlap):
        at = text.find(chunk, max(0, at + previous - overlap))
        previous = len(chunk)
        found.append((at, chunk))
    return found


def _cut(text: str, separators: tuple[str, ...], size: int, overlap: int) -> list[str]:
    """Cut at the coarsest separator present; pieces that stay too long go one level finer."""
    level = next(i for i, s in enumerate(separators) if s in text)
    finer = separators[level + 1 :]
    bounds = _bounds(text, separators[level])
    chunks: list[str] = []
    first = 0
    for i in _too_long(bounds, size):
        chunks += _packed(text, bounds, first, i, size, overlap)
        piece = text[bounds[i] : bounds[i + 1]]
        chunks += _cut(piece, finer, size, overlap) if finer else [piece]
        first = i + 1
    return chunks + _packed(text, bounds, first, len(bounds) - 1, size, overlap)


def _bounds(text: str, separator: str) -> Sequence[int]:
    """Where pieces begin that each keep the separator in front of them, and the end."""
    if not separator:
        return range(len(text) + 1)
    head, *tail = map(len, text.split(separator))
    ends = accumulate((n + len(separator) for n in tail), initial=head)
    return [0, *ends] if head else list(ends)


def _too_long(bounds: Sequence[int], size: int) -> Iterator[int]:
    if isinstance(bounds, range):
        return iter(range(len(bounds) - 1) if size <= 1 else ())
    return (i for i, (a, b) in enumerate(pairwise(bounds)) if b - a >= size)


def _packed(text: str, bounds: Sequence[int], first: int, last: int, size: int, overlap: int) -> list[str]:
    """Pieces ``first`` to ``last`` joined up to ``size``, repeating a tail of up to ``overlap``."""
    chunks: list[str] = []
    end = first
    while end < last:
        end = bisect_right(bounds, bounds[first] + size, first + 1, last + 1) - 1
        chunks.append(text[bounds[first] : bounds[end]].strip())
        if end < last:
            # The tail also has to leave room for the next piece.
            tail = max(bounds[end] - overlap, bounds[end + 1] - size)
            first = bisect_left(bounds, tail, first, end)
    return [c for c in chunks if c]
