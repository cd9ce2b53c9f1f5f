"""Byte-level helpers that several operators share: Arrow columns in, numpy arrays out."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import materialize

# Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX_A
    x ^= x >> np.uint64(27)
    x *= _MIX_B
    x ^= x >> np.uint64(31)
    return x


def random_table(seed: int) -> np.ndarray:
    """256 fixed 64-bit values, the same on every worker."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; every row is in exactly one."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown when a longer text comes."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, STEP_BYTES + 1)
            self.up = np.full(size, self.base, np.uint64)
            self.down = np.full(size, self.inverse, np.uint64)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up, self.down


class Spans:
    """Hashes of byte ranges of a text, each in constant time, from one running sum."""

    _powers = Powers(0x9E3779B97F4A7C55)

    def __init__(self, data: np.ndarray, table: np.ndarray) -> None:
        up, self._down = self._powers.upto(len(data))
        self._sum = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self._sum[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the n + 1 offsets of each row's words."""
    inside = is_word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    edges = offsets[(offsets >= 0) & (offsets <= len(data))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    closing = np.zeros(len(data) + 1, bool)
    closing[edges] = True
    ends = np.flatnonzero(inside & (~after[1:] | closing[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes that are not white space: everything but space and \t \n \v \f \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fresh(base: str, taken: Sequence[str]) -> str:
    """``base``, with underscores added until no column of ``taken`` has the name."""
    names = {c.lower() for c in taken}
    while base.lower() in names:
        base += "_"
    return base


def row_keyed(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` with a column that numbers its rows distinctly in the order of ``doc_id``, and its name.

    Where the ids are distinct and not null they are the numbers. Otherwise (repeated rows,
    null ids) the rows are laid out by id, null first, equal ids in the order of their
    texts, and numbered in a written table, so that a recomputed task sees the same keys.
    """
    key = fresh("key", docs.columns)
    repeated = docs.groupBy(F.col(doc_id).alias("id")).count().where("count > 1 or id is null").limit(1)
    if repeated.isEmpty():
        return docs.withColumn(key, F.col(doc_id).cast("long")), key
    ordered = docs.repartitionByRange(doc_id, text).sortWithinPartitions(doc_id, text)
    return materialize(ordered.withColumn(key, F.monotonically_increasing_id()), "row-keys"), key


def with_row_key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` as (key, doc_id, text), with the keys of :func:`row_keyed`."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed, key = row_keyed(slim, "doc_id", "text")
    return keyed.select(F.col(key).alias("key"), "doc_id", "text")


def _tie_larger(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours tied to the least of all its neighbours and itself."""
    least = (
        edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
    )
    tied = edges.join(least, edges["b"] == least["node"])
    return tied.select("a", F.least("b", "least").alias("b"))


def _tie_smaller(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours tied to the least of these (a node has few of them)."""
    grouped = edges.groupBy("a").agg(F.collect_set("b").alias("smaller"))
    least = F.array_min("smaller")
    tied = grouped.select(F.explode(F.array_union(F.array("a"), "smaller")).alias("a"), least.alias("b"))
    return tied.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): for every node of the edges (a, b) that is not the least of its component, the least.

    Alternates steps that tie the larger and the smaller neighbours of each node to the least,
    until all components are stars; the number of steps grows with the logarithm of the nodes.
    Every round is a written table. A node with many larger neighbours is summed up before it
    is shuffled, and its edges are only joined.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    while True:
        edges = materialize(_tie_smaller(_tie_larger(edges)), "edges")
        ends = edges.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")),
            F.struct(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")),
        )).alias("end")).select("end.*")
        nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if nodes.where("below > 1 or (below = 1 and above = 1)").isEmpty():
            return edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
