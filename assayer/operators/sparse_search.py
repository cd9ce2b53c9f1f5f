"""Exact top-k of sparse vectors over postings with block maxima.

Vectors that are read together are turned into postings: for each term that a query has, the rows that
hold it and their weights, with the largest weight in each block of rows. So a term that is everywhere is
split by ranges of rows, and its postings never meet in one place. A query's terms times their largest
weights bound what a block can give: the most promising block is scored first, and then only those blocks
whose bound reaches the k-th best score known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from assayer.operators.block_search import SCORE_DIGITS

# Rows, and terms of rows, whose postings are made together at most (but for one piece), and rows of a block.
CHUNK_ROWS, CHUNK_TERMS, BLOCK_ROWS = 8_192, 1 << 18, 64

# Rows of an Arrow batch that are taken out at a time.
_PIECE_ROWS = 1_024

_SLACK = 1e-9


class Sparse(NamedTuple):
    """Rows of term weights: ids, the n + 1 offsets of the rows, their terms in order, and weights."""

    ids: np.ndarray
    offsets: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def unit_counts(ids: np.ndarray, rows: np.ndarray, terms: np.ndarray, n_terms: int) -> Sparse:
    """How often each row has each term, at unit length; rows without a term are left out."""
    keys, counts = np.unique(rows * n_terms + terms, return_counts=True)
    owners = keys // n_terms
    length = np.bincount(owners, minlength=len(ids))
    norms = np.sqrt(np.bincount(owners, counts.astype(np.float64) ** 2, len(ids)))
    kept = length > 0
    return Sparse(ids[kept], np.concatenate([[0], np.cumsum(length[kept])]), keys % n_terms, counts / norms[owners])


class Postings:
    """The rows of a chunk by term, for the terms of ``vocabulary`` (in order)."""

    def __init__(self, rows: Sparse, vocabulary: np.ndarray, block: int = BLOCK_ROWS) -> None:
        owner = np.repeat(np.arange(len(rows.ids)), np.diff(rows.offsets))
        place = np.searchsorted(vocabulary, rows.terms)
        place[place == len(vocabulary)] = 0
        known = vocabulary[place] == rows.terms if len(vocabulary) else np.zeros(len(place), bool)
        order = np.argsort(place[known], kind="stable")
        term, self.rows, self.weights = place[known][order], owner[known][order], rows.weights[known][order]
        self.starts = np.searchsorted(term, np.arange(len(vocabulary) + 1))
        self.ids, self.n_blocks, self.block = rows.ids, -(-len(rows.ids) // block), block
        # Largest weights by term and block, kept only where there are any.
        keys = term * max(self.n_blocks, 1) + self.rows // block
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.max_block = (keys[first] % max(self.n_blocks, 1)).astype(np.int64)
        self.max_weight = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.max_starts = np.searchsorted(term[first], np.arange(len(vocabulary) + 1))

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the rows of each block can reach at most."""
        found = np.zeros(self.n_blocks)
        for t, w in zip(terms, weights):
            part = slice(self.max_starts[t], self.max_starts[t + 1])
            found[self.max_block[part]] += w * self.max_weight[part]
        return found + _SLACK

    def scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the chosen blocks (a mask) and their scores."""
        total = np.zeros(len(self.ids))
        for t, w in zip(terms, weights):
            part = slice(self.starts[t], self.starts[t + 1])
            own = self.rows[part]
            chosen = blocks[own // self.block]
            total[own[chosen]] += w * self.weights[part][chosen]
        rows = np.flatnonzero(np.repeat(blocks, self.block)[: len(self.ids)])
        return rows, np.round(total[rows], SCORE_DIGITS)


class SparseSearch:
    """The best ``k`` rows seen so far for each query; ``scored`` of ``possible`` blocks were needed."""

    def __init__(self, queries: Sparse, k: int, block: int = BLOCK_ROWS) -> None:
        self.queries, self.k, self.block = queries, k, block
        self.vocabulary = np.unique(queries.terms)
        self.places = np.searchsorted(self.vocabulary, queries.terms)
        n = len(queries.ids)
        self.best_scores, self.best_ids = [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n
        self.scored = self.possible = 0

    def add(self, rows: Sparse) -> None:
        if not len(rows.ids):
            return
        postings = Postings(rows, self.vocabulary, self.block)
        for q in range(len(self.queries.ids)):
            own = slice(self.queries.offsets[q], self.queries.offsets[q + 1])
            terms, weights = self.places[own], self.queries.weights[own]
            bounds = postings.bounds(terms, weights)
            left = bounds >= self._needed(q)
            self.possible += len(left)
            if not left.any():
                continue
            first = np.zeros(len(left), bool)
            first[np.argmax(bounds)] = True
            left &= ~first
            self._score(q, postings, terms, weights, first)
            left &= bounds >= self._needed(q)
            if left.any():
                self._score(q, postings, terms, weights, left)

    def _needed(self, q: int) -> float:
        return self.best_scores[q][-1] if len(self.best_scores[q]) == self.k else -np.inf

    def _score(self, q: int, postings: Postings, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> None:
        self.scored += int(blocks.sum())
        rows, scores = postings.scores(terms, weights, blocks)
        better = scores >= self._needed(q)
        rows, scores = rows[better], scores[better]
        if len(scores) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            rows, scores = rows[scores >= least], scores[scores >= least]
        scores = np.concatenate([self.best_scores[q], scores])
        ids = np.concatenate([self.best_ids[q], postings.ids[rows]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.best_scores[q], self.best_ids[q] = scores[order], ids[order]

    def hits(self) -> pa.Table:
        lengths = [len(x) for x in self.best_ids]
        none = np.zeros(0)
        return pa.table({
            "query_id": np.repeat(self.queries.ids, lengths).astype(np.int64),
            "corpus_id": np.concatenate([none.astype(np.int64), *self.best_ids]),
            "score": np.concatenate([none, *self.best_scores]),
        })


def from_table(table: pa.Table | pa.RecordBatch) -> Sparse:
    """Rows of (id, terms, weights), in the order of their ids."""
    order = pc.sort_indices(table.column(0))
    ids, terms, weights = (table.column(i).take(order) for i in range(3))
    if isinstance(terms, pa.ChunkedArray):
        ids, terms, weights = ids.combine_chunks(), terms.combine_chunks(), weights.combine_chunks()
    lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    return Sparse(
        ids.to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64), weights.flatten().to_numpy(zero_copy_only=False),
    )


def to_batch(rows: Sparse, names: tuple[str, str, str]) -> pa.RecordBatch:
    offsets = pa.array(rows.offsets, pa.int32())
    columns = [pa.array(rows.ids, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(rows.terms, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(rows.weights, pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=list(names))


def stored_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Sparse]:
    """Rows of (id, terms, weights), a few at a time, whatever an Arrow batch holds."""
    for batch in batches:
        for first in range(0, len(batch), _PIECE_ROWS):
            yield from_table(batch.slice(first, _PIECE_ROWS))


def joined(parts: list[Sparse]) -> Sparse:
    lengths = np.concatenate([np.diff(part.offsets) for part in parts])
    ids, terms, weights = (np.concatenate([part[i] for part in parts]) for i in (0, 2, 3))
    return Sparse(ids, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), terms, weights)


def searching(
    load: Callable[[], Sparse], k: int, read: Callable[[Iterator[pa.RecordBatch]], Iterator[Sparse]] = stored_parts
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with the rows that ``read`` finds in its batches: its best ``k`` for every query.

    Postings are made of a number of terms that does not depend on the length of the texts.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = SparseSearch(load(), k)
        waiting: list[Sparse] = []
        for part in read(batches):
            waiting.append(part)
            if sum(len(p.ids) for p in waiting) >= CHUNK_ROWS or sum(len(p.terms) for p in waiting) >= CHUNK_TERMS:
                best.add(joined(waiting))
                waiting = []
        if waiting:
            best.add(joined(waiting))
        yield from best.hits().to_batches()

    return search
