"""ROUGE: n-gram overlap and longest common subsequences, each row by itself in Arrow batches.

Scores are plain means over the examples, without resampling.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import NON_TOKEN, token_codes

KEYS = ("model", "task", "idx")

# Pairs of texts whose n-grams are counted together.
_STEP_ROWS = 512

# Bits of the matrix of a longest common subsequence that are kept at a time, about.
_KEPT_BITS = 1 << 24


def rouge_n(scored: DataFrame, sizes: Sequence[int] = (1, 2), keys: Sequence[str] = KEYS) -> DataFrame:
    """F-measure per example: ``keys`` and one column ``rouge<n>`` per size.

    A row needs only its own two texts, so nothing is shuffled.
    """
    names = [f"rouge{n}" for n in sizes]

    @F.pandas_udf(", ".join(f"{name} double" for name in names))
    def measure(predictions: pd.Series, references: pd.Series) -> pd.DataFrame:
        columns = {name: [] for name in names}
        for at in range(0, len(predictions), _STEP_ROWS):
            step = slice(at, at + _STEP_ROWS)
            for name, values in zip(names, overlaps(predictions[step], references[step], sizes)):
                columns[name].append(values)
        return pd.DataFrame({name: np.concatenate(parts or [np.zeros(0)]) for name, parts in columns.items()})

    scores = scored.select(*keys, measure(F.lower("prediction"), F.lower("reference")).alias("_score"))
    return scores.select(*keys, *(f"_score.{name}" for name in names))


def overlaps(predictions: Sequence[str | None], references: Sequence[str | None], sizes: Sequence[int]) -> list[np.ndarray]:
    """F-measures of n-grams for pairs of texts in lower case, by counting all pairs' n-grams at once."""
    n_rows = len(predictions)
    rows, codes, names = token_codes(pa.array([*predictions, *references], pa.large_string()))
    out = []
    for n in sizes:
        # Numbers for the n-grams of all rows, one token longer at a time, so that they stay small.
        starts, grams = np.arange(len(codes)), codes
        for k in range(1, n):
            whole = starts + k < len(codes)
            whole[whole] = rows[starts[whole] + k] == rows[starts[whole]]
            starts = starts[whole]
            _, grams = np.unique(grams[whole] * len(names) + codes[starts + k], return_inverse=True)
        at = rows[starts]
        width = int(grams.max(initial=0)) + 1
        keys, counts = np.unique(at * width + grams, return_counts=True)
        right = keys >= n_rows * width
        _, left_at, right_at = np.intersect1d(keys[~right], keys[right] - n_rows * width, assume_unique=True, return_indices=True)
        shared = np.minimum(counts[~right][left_at], counts[right][right_at])
        hits = np.bincount(keys[~right][left_at] // width, shared, n_rows)
        totals = np.bincount(at, minlength=2 * n_rows)
        totals = totals[:n_rows] + totals[n_rows:]
        out.append(np.where(hits > 0, 2.0 * hits / np.maximum(totals, 1), 0.0))
    return out


def _tokens(text: str | None) -> list[str]:
    """The tokens of a text in lower case."""
    return [t for t in re.split(NON_TOKEN, text or "") if t]


def overlap_f(predicted: list[str], expected: list[str], n: int) -> float:
    left, right = (Counter(zip(*(tokens[i:] for i in range(n)))) for tokens in (predicted, expected))
    small, large = sorted((left, right), key=len)
    hits = sum(min(count, large[gram]) for gram, count in small.items())
    return _f(hits, left.total(), right.total())


def rouge_l(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """F-measure per example from longest common subsequences: ``rougeL``, ``rougeLsum``.

    A row needs only its own two texts. The work grows with the square of their length, so rows
    are rebalanced by size first; adaptive execution chooses the number of tasks.
    """

    @F.pandas_udf("rougeL double, rougeLsum double")
    def measure(predictions: pd.Series, references: pd.Series) -> pd.DataFrame:
        return subsequences(predictions, references)

    pairs = scored.select(*keys, "prediction", "reference").hint("rebalance")
    scores = pairs.select(*keys, measure("prediction", "reference").alias("_score"))
    return scores.select(*keys, "_score.rougeL", "_score.rougeLsum")


def subsequences(predictions: Sequence[str | None], references: Sequence[str | None]) -> pd.DataFrame:
    """``rougeL`` and ``rougeLsum`` of pairs of texts; only one pair is held as tokens."""
    found = np.zeros((len(predictions), 2))
    for i, pair in enumerate(zip(predictions, references)):
        predicted, expected = map(_sentences, pair)
        found[i] = lcs_f(list(chain.from_iterable(predicted)), list(chain.from_iterable(expected))), lcs_union_f(predicted, expected)
    return pd.DataFrame(found, columns=["rougeL", "rougeLsum"])


def _sentences(text: str | None) -> list[list[str]]:
    """The tokens of every line; a line break never lies inside a token."""
    return [[t for t in re.split(NON_TOKEN, line.lower()) if t] for line in (text or "").split("\n") if line]


def _f(hits: int, predicted: int, expected: int) -> float:
    return 2.0 * hits / (predicted + expected) if hits else 0.0


def _places(tokens: list[str]) -> dict[str, int]:
    """Bit i is set for the token at position i."""
    places: dict[str, int] = {}
    for i, token in enumerate(tokens):
        places[token] = places.get(token, 0) | (1 << i)
    return places


def _growth(places: dict[str, int], size: int, other: list[str], row: int | None = None) -> Iterator[int]:
    """Bit-parallel LCS (Hyyrö): one integer per prefix of ``other``, the empty one first.

    With ``row`` it goes on behind the prefix that had this integer.

    Bit i is 0 where the LCS with that prefix grows as position i of the first sequence
    joins in.
    """
    everything = (1 << size) - 1
    row = everything if row is None else row
    yield row
    for token in other:
        matched = row & places.get(token, 0)
        if matched:
            row = ((row + matched) | (row - matched)) & everything
        yield row


def lcs_f(predicted: list[str], expected: list[str]) -> float:
    last = 0
    for last in _growth(_places(predicted), len(predicted), expected):
        pass
    return _f(len(predicted) - last.bit_count(), len(predicted), len(expected))


def lcs_union_f(predicted: list[list[str]], expected: list[list[str]]) -> float:
    """Each expected sentence counts the tokens that any predicted sentence shares in order."""
    left = Counter(t for s in predicted for t in s)
    right = Counter(t for s in expected for t in s)
    n_predicted, n_expected = left.total(), right.total()
    hits = 0
    for sentence in expected:
        places = _places(sentence)
        shared = 0
        for other in predicted:
            shared |= _lcs_positions(places, len(sentence), other)
        for i, token in enumerate(sentence):
            if shared >> i & 1 and left[token] > 0 and right[token] > 0:
                hits += 1
                left[token] -= 1
                right[token] -= 1
    return _f(hits, n_predicted, n_expected)


def _lcs_positions(places: dict[str, int], size: int, other: list[str]) -> int:
    """Positions of one LCS in the first sequence, as bits.

    Walks back from the ends. A match is always taken; otherwise the first sequence is
    shortened as long as that keeps the length, and then ``other`` is. Of the rows on the way only
    every n-th is kept where they are many; those between are made again when the walk gets there.
    """
    step = max(1, math.isqrt(len(other)) if size * len(other) > _KEPT_BITS else len(other))
    kept = [row for j, row in enumerate(_growth(places, size, other)) if j % step == 0]
    full, found, j = size, 0, len(other)
    while j > 0 and size:
        first = (j - 1) // step * step
        rows = list(_growth(places, full, other[first:j], kept[first // step]))
        while j > first and size:
            match = places.get(other[j - 1], 0)
            size = ((match | ~rows[j - first]) & ((1 << size) - 1)).bit_length()
            if size and match >> (size - 1) & 1:
                size -= 1
                found |= 1 << size
            j -= 1
    return found
