"""Short codes for vectors: integer product quantisation, nearest entries found by LAESA pivots.

Vectors become integers and are cut into equal parts, each with a codebook of its own that a
few rounds of k-means improve. Before the rounds, the distances of every part to a few fixed
pivots are computed once and stored beside it. In a round only the distances from the pivots to
the codebook's entries are new: by the triangle inequality the difference of the two is a lower
bound for the distance of part and entry. Entries are tried in the order of their bounds, and
those whose bound is above the least distance found so far are never evaluated. Evaluations are
exact, in integers.

A round is one pass over the stored parts. A task sums up what it assigned to each entry, so it
sends at most one row per part, entry and component, however many vectors it reads and however
many of them are equal; the driver sees codebooks only.

Rows without a usable vector (null, or with null or non-finite components) are left out. Repeated
rows and repeated or null ids count as rows of their own; the codebooks start from the least ids,
null first, equal ids in the order of their vectors. Fewer rows than entries give smaller
codebooks, an empty table gives no rows, vectors without components get code 0 in every part.
Vectors must have one length, a multiple of the number of parts; others are an error that names
the row. Integers saturate where squared distances would leave 64 bits (at 2^27 for 64
components). All other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import fresh
from assayer.session import broadcast_if_small, materialize

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 4, 256, 4, 1024, 8

# Entries of the lowest bounds that are evaluated before the others are pruned.
_FIRST = 8

# Share of pairs that bounds may leave over before a step's distances are worked out as one product of
# matrices, which then takes less time than to pick the pairs.
_DENSE = 0.1

# Parts that one vectorised step works on.
_STEP = 2_048

# Distances have 24 bits here; bounds are lowered by more than they may be off.
_SLACK = 2e-6

Books = list[np.ndarray]


def _usable(vector: Column) -> Column:
    """Whether a vector of doubles is there and all of it is finite."""
    infinite = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))


def _limit(width: int) -> int:
    """What integers saturate at: the squares of ``width`` differences add up in 64 bits."""
    return 1 << (62 - max(width - 1, 0).bit_length()) // 2 - 1


def _integers(vector: Column, width: int, scale: int) -> Column:
    limit = float(_limit(width))
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(limit)), F.lit(-limit))), F.lit(limit)), F.lit(-limit)).cast("int"))


def exact(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows that stand side by side."""
    apart = parts - entries
    return np.einsum("ij,ij->i", apart, apart)


def choose_pivots(book: np.ndarray, n: int) -> np.ndarray:
    """``n`` entries that lie far from each other, the first one of the book among them."""
    chosen = [0]
    nearest = exact(book, book[:1])
    while len(chosen) < min(n, len(book)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, exact(book, book[chosen[-1] :][:1]))
    return book[chosen]


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows x pivots), from exact squares."""
    return np.sqrt(np.stack([exact(rows, p[None]) for p in pivots], axis=1).astype(np.float64))


def nearest(parts: np.ndarray, stored: np.ndarray, book: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of every part's nearest entry, and the number of evaluations.

    ``stored`` has the parts' distances to the pivots, ``to_pivots`` those of the entries. Equal
    distances go to the lower index.
    """
    index, best, evaluated = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
    for at in range(0, len(parts), _STEP):
        step = slice(at, at + _STEP)
        index[step], best[step], n = _nearest(parts[step], stored[step], book, to_pivots)
        evaluated += n
    return index, best, evaluated


def _nearest(parts: np.ndarray, stored: np.ndarray, book: np.ndarray, to_pivots: np.ndarray):
    n, size = len(parts), len(book)
    bounds = _bounds(stored, to_pivots)
    few = min(_FIRST, size)
    first = np.argpartition(bounds, few - 1, axis=1)[:, :few]
    found = exact(np.repeat(parts, few, axis=0), book[first.ravel()]).reshape(n, few)
    least = found.min(axis=1)
    left = bounds <= np.sqrt(least.astype(np.float64))[:, None]
    np.put_along_axis(left, first, True, axis=1)
    evaluated = int(left.sum())
    if evaluated > _DENSE * left.size:
        squares = np.where(left, _all_squares(parts, book), np.iinfo(np.int64).max)
        index = squares.argmin(axis=1)
        return index, squares[np.arange(n), index], evaluated
    np.put_along_axis(left, first, False, axis=1)
    row, entry = np.nonzero(left)
    # What is left is evaluated in the order of the bounds, a few per row at a time.
    order = np.lexsort((bounds[row, entry], row))
    row, entry = row[order], entry[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    rows, entries, squares = [np.repeat(np.arange(n), few)], [first.ravel()], [found.ravel()]
    turn = 0
    while len(row):
        now = place < (turn + 1) * 4 * few
        rows.append(row[now])
        entries.append(entry[now])
        squares.append(exact(parts[row[now]], book[entry[now]]))
        np.minimum.at(least, row[now], squares[-1])
        row, entry, place = row[~now], entry[~now], place[~now]
        still = bounds[row, entry] <= np.sqrt(least[row].astype(np.float64))
        row, entry, place = row[still], entry[still], place[still]
        turn += 1
    rows, entries, squares = map(np.concatenate, (rows, entries, squares))
    tie = squares == least[rows]
    index = np.full(n, size)
    np.minimum.at(index, rows[tie], entries[tie])
    return index, least, len(squares)


def _bounds(stored: np.ndarray, to_pivots: np.ndarray) -> np.ndarray:
    """Lower bounds (parts x entries) of distances, a little below the differences for rounding."""
    stored, to_pivots = stored.astype(np.float32), to_pivots.astype(np.float32)
    bounds = np.zeros((len(stored), len(to_pivots)), np.float32)
    apart = np.empty_like(bounds)
    for p in range(stored.shape[1]):
        np.subtract(stored[:, p, None], to_pivots[None, :, p], out=apart)
        np.abs(apart, out=apart)
        np.maximum(bounds, apart, out=bounds)
    reach = stored.max(axis=1, initial=0.0)[:, None] + to_pivots.max(axis=1, initial=0.0)[None, :]
    bounds -= np.float32(_SLACK) * (reach + 1)
    return bounds


def _all_squares(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows and entries, as one product of matrices; whole numbers below 2^53 are exact in doubles."""
    width = max(parts.shape[1], 1)
    largest = int(np.abs(parts).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.float64 if width * largest * largest < 1 << 52 else np.int64
    left, right = parts.astype(kind), book.astype(kind)
    squares = (left * left).sum(axis=1)[:, None] + (right * right).sum(axis=1)[None, :] - 2 * (left @ right.T)
    return squares.astype(np.int64)


def _cut(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(vectors, parts, axis=1)


def _rows(column: pa.Array | pd.Series, kind: type, width: int) -> np.ndarray:
    """Packed rows as a matrix."""
    packed = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(packed), kind).reshape(len(column), width)


class Coder:
    """Codebooks with their distances to the pivots; what tasks need to assign parts."""

    def __init__(self, books: Books, pivots: Books) -> None:
        self.books, self.pivots = books, pivots
        self.width = sum(b.shape[1] for b in books)
        self.to_pivots = [distances(b, p) for b, p in zip(books, pivots)]
        self.n_stored = sum(map(len, pivots))

    def assign(self, integers: np.ndarray, stored: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per part position: its components, the entries' indices and the squared distances."""
        at = 0
        for book, pivots, to_pivots, part in zip(self.books, self.pivots, self.to_pivots, _cut(integers, len(self.books))):
            part = part.astype(np.int64)
            index, square, _ = nearest(part, stored[:, at : at + len(pivots)], book, to_pivots)
            at += len(pivots)
            yield part, index, square

    def unpack(self, integers, stored) -> tuple[np.ndarray, np.ndarray]:
        return _rows(integers, np.int32, self.width), _rows(stored, np.float32, self.n_stored).astype(np.float64)


def _sums(coder: Coder) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per part and entry the number and the sums of what a task assigned to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in coder.books]
        sums = [np.zeros(b.shape, np.int64) for b in coder.books]
        for batch in batches:
            for i, (part, index, _) in enumerate(coder.assign(*coder.unpack(batch.column(0), batch.column(1)))):
                counts[i] += np.bincount(index, minlength=len(counts[i]))
                np.add.at(sums[i], index, part)
        for i, (count, total) in enumerate(zip(counts, sums)):
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), i, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                names=["part", "entry", "n", "sums"],
            )

    return run


def improve(stored: DataFrame, coder: Coder) -> Books:
    """The codebooks after one round: every used entry is the floor of its parts' means."""
    sums = stored.select("integers", "stored").mapInArrow(_sums(coder), "part int, entry int, n long, sums array<long>")
    total = sums.select("part", "entry", "n", F.posexplode("sums").alias("place", "value")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value")).toArrow()
    books = [b.copy() for b in coder.books]
    part, entry, place, n, value = (total.column(c).to_numpy() for c in ("part", "entry", "place", "n", "value"))
    for i, book in enumerate(books):
        own = part == i
        book[entry[own], place[own]] = value[own] // n[own]
    return books


def encode(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    pivots: int = PIVOTS,
) -> tuple[DataFrame, str, Books]:
    """Rows of ``df`` with a usable vector and a column (code binary, error long), its name, the codebooks.

    The code has one byte per part (so ``entries`` is at most 256), the error is the squared
    distance of the integers to what the code stands for. The vector itself is left out. The
    result is a written table.
    """
    if not 1 <= entries <= 256:
        raise ValueError("Entries are numbered by one byte")
    values, integers, coded = (fresh(n, df.columns) for n in ("values", "integers", "coded"))
    kept = df.withColumn(values, F.col(vector).cast("array<double>")).where(_usable(F.col(values)))
    least = kept.select(F.col(vec_id).alias("id"), F.col(values).alias("v")).orderBy("id", "v").limit(entries).toArrow()
    others = [c for c in df.columns if c != vector]
    if not least.num_rows:
        empty = F.lit(None).cast("struct<code:binary, error:long>")
        return kept.select(*others, empty.alias(coded)).limit(0), coded, [np.zeros((0, 0), np.int64)] * parts
    width = len(least.column("v")[0])
    if width % parts:
        raise ValueError(f"Vectors of {width} components can't be cut into {parts} equal parts")
    told = F.concat(F.lit(f"The vector is not of length {width}: {vec_id} "), F.coalesce(F.col(vec_id).cast("string"), F.lit("null")))
    checked = F.when(F.size(values) == width, F.col(values)).otherwise(F.raise_error(told).cast("array<double>"))
    whole = kept.select(*others, _integers(checked, width, scale).alias(integers))
    for row in least.to_pylist():
        if len(row["v"]) != width:
            raise ValueError(f"The vector is not of length {width}: {vec_id} {row['id']}")
    limit = _limit(width)
    start = np.array(least.column("v").to_pylist(), np.float64).reshape(least.num_rows, width)
    start = np.floor(np.clip(start * scale, -limit, limit)).astype(np.int64)
    books = [np.ascontiguousarray(b) for b in _cut(start, parts)]
    fixed = [choose_pivots(b, pivots) for b in books]

    @F.pandas_udf("integers binary, stored binary")
    def measure(vectors: pd.Series) -> pd.DataFrame:
        rows = np.stack(vectors.to_list()).astype(np.int32).reshape(len(vectors), width) if len(vectors) else np.zeros((0, width), np.int32)
        far = [distances(part.astype(np.int64), p) for part, p in zip(_cut(rows, parts), fixed)]
        far = np.hstack(far).astype(np.float32)
        return pd.DataFrame({"integers": [r.tobytes() for r in rows], "stored": [r.tobytes() for r in far]})

    packed = fresh("packed", others)
    table = materialize(whole.select(*others, measure(F.col(integers)).alias(packed)), "vector-parts")
    for _ in range(rounds):
        books = improve(table.select(f"{packed}.integers", f"{packed}.stored"), Coder(books, fixed))
    coder = Coder(books, fixed)

    @F.pandas_udf("code binary, error long")
    def code(rows: pd.DataFrame) -> pd.DataFrame:
        found = list(coder.assign(*coder.unpack(rows["integers"], rows["stored"])))
        codes = np.stack([index for _, index, _ in found], axis=1).astype(np.uint8)
        return pd.DataFrame({"code": [c.tobytes() for c in codes], "error": sum(square for _, _, square in found)})

    return materialize(table.select(*others, code(F.col(packed)).alias(coded)), "vector-codes"), coded, books


def with_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of an equal ``key``, nulls together.

    Sums are made up before they are shuffled; they go to where the rows lie if they are few,
    otherwise adaptive execution splits a key that holds many rows. ``df`` is read twice.
    """
    own, total = fresh("total_key", df.columns), fresh("total", df.columns)
    totals = df.groupBy(F.col(key).alias(own)).agg(F.sum(value).alias(total))
    joined = df.join(broadcast_if_small(totals), F.col(key).eqNullSafe(F.col(own)), "left")
    return joined.select(*df.columns, F.col(total).alias(name))


def books_digest(books: Books) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    digits = ",".join(str(x) for book in books for entry in book.tolist() for x in entry)
    return hashlib.sha256(digits.encode()).hexdigest()
