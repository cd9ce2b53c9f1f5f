"""Main text of web pages: the contiguous stretch of a page with the best score.

Words score by where they stand, tags always score against; the weights are log-odds counted on
labelled pages, those that mark their main text with an article or main element. On marked pages
it counts whether a piece is inside the mark, on others which block element it is in and whether
in a link. One scan finds the stretch with the largest sum, as in the maximum subsequence
problem. What stands aside within it (an advert between two paragraphs, a form, reader comments)
is left out of the text.

Null and empty pages, and pages without a word in the stretch, have an empty text. Rows are
extracted one by one, so repeated rows give equal rows and an empty table an empty table.
Without any labelled page the weights are :data:`DEFAULT`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.markup import BLOCK, Piece, blocks, pieces

#: Labelled pages that the weights are counted on.
SAMPLE = 2000
_LIMIT = 3.0
_TAG_COST = 0.05

#: Weights of features that no labelled page has, by their first words.
DEFAULT = {
    "word aside": -0.02, "word block": 1.0, "word link": -1.0, "tag aside": -_TAG_COST, "tag block": -0.2,
}

Weights = dict[str, float]


def _feature(piece: Piece) -> str:
    """What a piece is scored by: the block that it is or stands in, and whether it is a link.

    A page's own mark of its main text labels pages to learn from; it is no feature. What stands
    aside is left out of the text in any case, so it hardly counts.
    """
    kind = "tag" if piece.tag else "word"
    if piece.aside:
        return f"{kind} aside"
    if piece.tag:
        name = piece.tag.lstrip("/")
        return f"tag block {name}" if name in BLOCK else "tag block"
    return f"word link {piece.block}" if piece.link else f"word block {piece.block}"


def _fallback(feature: str) -> float:
    return DEFAULT[" ".join(feature.split(" ")[:2])]


def count_features(page: str) -> Iterator[tuple[str, int, int]]:
    """(feature, words or tags inside the marked main text, outside) of a labelled page."""
    counts: dict[str, list[int]] = {}
    for piece in pieces(page):
        n = 1 if piece.tag else len(piece.text.split())
        if n and not piece.aside:
            counts.setdefault(_feature(piece), [0, 0])[0 if piece.main else 1] += n
    return ((f, a, b) for f, (a, b) in counts.items())


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [row for page in batch.column("html").to_pylist() for row in count_features(page or "")]
        features, inside, outside = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(features, pa.string()), pa.array(inside, pa.int64()), pa.array(outside, pa.int64())],
            names=["feature", "inside", "outside"],
        )


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from about ``sample`` pages that mark their main text, chosen by a hash of the page.

    Where there are fewer all are taken. The pages are read in place, and the counts come to the
    driver summed up by feature, of which there are a few hundred.
    """
    body = pages.select(F.col(html).cast("string").alias("html"))
    marked = body.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    share = sample / max(marked.count(), 1)
    chosen = marked if share >= 1 else marked.where(F.pmod(F.xxhash64("html"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counts = (
        chosen.mapInArrow(_counting, "feature string, inside long, outside long")
        .groupBy("feature").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    )
    return weights_of((r["feature"], r["inside"], r["outside"]) for r in counts)


def weights_of(counts: Iterable[tuple[str, int, int]]) -> Weights:
    """Log-odds that a word or tag with a feature is in the main text; tags never score in favour."""
    out: Weights = {}
    for feature, inside, outside in counts:
        odds = max(-_LIMIT, min(_LIMIT, math.log((inside + 1) / (outside + 1))))
        out[feature] = odds if feature.startswith("word") else min(-_TAG_COST, odds / 2)
    return out


def best_stretch(scores: Iterable[float]) -> tuple[int, int]:
    """(first, end) of the contiguous scores with the largest positive sum; (0, 0) without one."""
    best, first, end = 0.0, 0, 0
    total, since = 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, since = 0.0, i
        total += score
        if total > best:
            best, first, end = total, since, i + 1
    return first, end


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page, blocks separated by empty lines."""
    parts = list(pieces(page or ""))
    scores = []
    for piece in parts:
        feature = _feature(piece)
        weight = weights.get(feature)
        if weight is None:
            weight = weights[feature] = _fallback(feature)
        scores.append(weight if piece.tag else weight * len(piece.text.split()))
    first, end = best_stretch(scores)
    # Tags of what is left out still separate blocks.
    return "\n\n".join(blocks(p for p in parts[first:end] if p.tag or not p.aside))


def _extracting(weights: Broadcast, html: str, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(weights.value)
        for batch in batches:
            names = [n for n in batch.schema.names if n != text]
            # A few pages at a time, so that what goes out is as small as what came in.
            for at in range(0, len(batch), 500):
                rows = batch.slice(at, 500)
                column = pa.array([extract(page.as_py(), known) for page in rows.column(html)], pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), column], names=[*names, text])

    return run


def extract_text(pages: DataFrame, html: str = "html", text: str = "text", weights: Weights | None = None) -> DataFrame:
    """``pages`` with their main text, with weights fitted on the pages themselves if none are given.

    A column named ``text`` is replaced, unless it is ``html`` itself.
    """
    weights = fit(pages, html) if weights is None else weights
    known = pages.sparkSession.sparkContext.broadcast(weights)
    pages = pages if text == html else pages.drop(text)
    fields = [f for f in pages.schema.fields if f.name != text]
    return pages.mapInArrow(_extracting(known, html, text), T.StructType([*fields, T.StructField(text, T.StringType())]))
