"""Exact top-k of a block of queries over vectors that lie in blocks, by upper bounds.

Vectors that are read together are gathered around pivots into small blocks with a centroid, a radius
and a largest norm; so are the queries, once. By Cauchy and Schwarz no vector of a block has a higher
inner product with a query than the centroid's plus the query's norm times the radius, nor than the
product of the norms. Each query block visits the blocks in the order of such bounds and stops where
none of its queries can gain: hits never are lost, and blocks far from everything known are not scored.

Once a query has ``k`` hits, single precision tells which vectors could still be one, within a bound on
its error; only those are scored in full. No matrix grows with the number of queries or of vectors.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Scores are compared at this many decimals, so copies of a vector tie exactly.
SCORE_DIGITS = 12

# Rows of a block, about, and passes that pull pivots to the middle of their blocks.
BLOCK_ROWS, _PASSES = 256, 2

# Vectors that are ordered into blocks together.
CHUNK_ROWS = 16_384

# Rows that are compared with all centres at a time.
_STEP_ROWS = 4_096

# Blocks that are scored together, and pairs that are scored in full together, at most.
_TOGETHER, _PAIRS = 16, 16_384

# What bounds are raised by, for the rounding of scores and sums.
_SLACK = 1e-9

# Two ways to add up a score may round it to neighbours.
_ROUNDED = 2 * 10.0**-SCORE_DIGITS

# Components up to this size go through single precision; its error for each component and unit of norms, twice over.
_LARGEST, _SINGLE = 1e15, 2.0**-23


class Block(NamedTuple):
    """Vectors ``rows`` of a chunk around a centre."""

    rows: np.ndarray
    centre: np.ndarray
    radius: float
    norm: float


def blocks(vectors: np.ndarray, size: int = BLOCK_ROWS) -> list[Block]:
    """The rows of a matrix in blocks of ``size`` rows on average, near ones together."""
    n = len(vectors)
    if not n:
        return []
    centres = vectors[np.linspace(0, n - 1, max(n // size, 1)).astype(np.int64)]
    owner = np.zeros(n, np.int64)
    for _ in range(_PASSES if len(centres) > 1 else 0):
        sums, half = np.zeros_like(centres), (centres**2).sum(axis=1) / 2
        for at in range(0, n, _STEP_ROWS):
            part = vectors[at : at + _STEP_ROWS]
            own = np.argmax(part @ centres.T - half, axis=1)
            owner[at : at + _STEP_ROWS] = own
            order = np.argsort(own, kind="stable")
            used, first = np.unique(own[order], return_index=True)
            sums[used] += np.add.reduceat(part[order], first, axis=0)
        counts = np.bincount(owner, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    order = np.argsort(owner, kind="stable")
    found = []
    for rows in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
        # A block that many rows fall into is divided, so that no step takes more than a few.
        for part in np.array_split(rows, -(-len(rows) // (4 * size))):
            centre = vectors[part].mean(axis=0)
            radius = np.sqrt(((vectors[part] - centre) ** 2).sum(axis=1).max())
            found.append(Block(part, centre, float(radius), float(norms[part].max())))
    return found


class BlockSearch:
    """The best ``k`` of all vectors seen so far for each query, with the number of block visits.

    ``known`` are scores that ``k`` vectors reach for sure; hits below them are not kept.
    """

    def __init__(self, queries: np.ndarray, k: int, known: np.ndarray | None = None, size: int = BLOCK_ROWS) -> None:
        self.queries, self.k = queries, k
        self.groups = blocks(queries, size)
        self.norms = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        self.known = np.full(len(queries), -np.inf) if known is None else known - _ROUNDED
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.size = size
        self.visited = self.possible = 0

    def _needed(self, rows: np.ndarray) -> np.ndarray:
        """What a score must reach to matter."""
        return np.maximum(self.known[rows], self.scores[rows, -1])

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), CHUNK_ROWS):
            self._add(ids[at : at + CHUNK_ROWS], vectors[at : at + CHUNK_ROWS])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        found = blocks(vectors, self.size)
        centres = np.stack([b.centre for b in found])
        radii, norms = np.array([b.radius for b in found]), np.array([b.norm for b in found])
        # Vectors of a block lie together from here on.
        ends = np.cumsum([len(b.rows) for b in found])
        places = [np.arange(end - len(b.rows), end) for b, end in zip(found, ends)]
        order = np.concatenate([b.rows for b in found])
        ids, vectors = ids[order], vectors[order]
        error = (vectors.shape[1] + 8) * _SINGLE * norms.max()
        single = vectors.astype(np.float32) if np.abs(vectors).max(initial=0.0) <= _LARGEST else None
        for group in self.groups:
            self.possible += len(found)
            own = self.queries[group.rows]
            usable = single is not None and np.abs(own).max(initial=0.0) <= _LARGEST
            # Bounds for each query and block: by centre and radius, and by norms.
            bounds = own @ centres.T + self.norms[group.rows, None] * radii
            bounds = np.minimum(bounds, self.norms[group.rows, None] * norms)
            bounds += _SLACK * (1 + np.abs(bounds) + self.norms[group.rows, None] * norms)
            visits, at, n = np.argsort(-bounds.max(axis=0), kind="stable"), 0, 1
            while at < len(visits):
                needed = self._needed(group.rows)
                full = usable and np.isfinite(needed).all()
                chosen = visits[at : at + (n if full else 1)]
                reached = bounds[:, chosen] >= needed[:, None]
                if not reached[:, 0].any() and bounds[:, chosen[0]].max() < needed.min():
                    break
                at, n = at + len(chosen), min(2 * n, _TOGETHER) if full else 1
                chosen, rows = chosen[reached.any(axis=0)], reached.any(axis=1)
                self.visited += len(chosen)
                if full and len(chosen):
                    columns = np.concatenate([places[b] for b in chosen])
                    least = needed[rows] - error * self.norms[group.rows[rows]] - _ROUNDED
                    least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
                    near = own[rows].astype(np.float32) @ single[columns].T >= least[:, None]
                    pair = np.flatnonzero(near)
                    if len(pair) <= _PAIRS:
                        row, column = np.divmod(pair, len(columns))
                        self._merge_pairs(group.rows[rows][row], ids, vectors, columns[column])
                        continue
                for b in chosen:
                    self._merge(group.rows[reached.any(axis=1)], ids[places[b]], vectors[places[b]])

    def _merge_pairs(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, columns: np.ndarray) -> None:
        """Single vectors for single queries."""
        scores = np.round(np.einsum("ij,ij->i", self.queries[rows], vectors[columns]), SCORE_DIGITS)
        better = scores >= self._needed(rows)
        if not better.any():
            return
        used, row = np.unique(rows[better], return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(used)), self.k), row])
        scores = np.concatenate([self.scores[used].ravel(), scores[better]])
        found = np.concatenate([self.ids[used].ravel(), ids[columns[better]]])
        order = np.lexsort((found, -scores, row))
        kept = order[np.searchsorted(row[order], np.arange(len(used)))[:, None] + np.arange(self.k)]
        self.scores[used], self.ids[used] = scores[kept], found[kept]

    def _merge(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = np.round(self.queries[rows] @ vectors.T, SCORE_DIGITS)
        better = scores >= self._needed(rows)[:, None]
        gains = better.any(axis=1)
        if not gains.any():
            return
        rows, scores = rows[gains], np.where(better[gains], scores[gains], -np.inf)
        if scores.shape[1] > self.k:
            # By score and then by id: the k-th score tells which columns can stay.
            least = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]
            width = int((scores >= least[:, None]).sum(axis=1).max())
            order = np.argsort(-scores, axis=1, kind="stable")[:, :width]
            scores, ids = np.take_along_axis(scores, order, axis=1), ids[order]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        ids = np.where(np.isfinite(scores), ids, np.iinfo(np.int64).max)
        scores = np.hstack([self.scores[rows], scores])
        ids = np.hstack([self.ids[rows], ids])
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.ids[rows] = np.take_along_axis(ids, order, axis=1)

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of queries, ids and scores."""
        row, place = np.nonzero(np.isfinite(self.scores))
        return row, self.ids[row, place], self.scores[row, place]
