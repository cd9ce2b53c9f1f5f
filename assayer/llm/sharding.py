"""Shards cut from a Hilbert curve through several metadata columns.

Each column is quantised into cells that hold about equally many rows, a row's cells give its
place on the curve, and the rows in that order are cut into runs of equal length. Rows near
each other on the curve are near in every column, so a shard covers a narrow range of each,
and a filter on any of them skips most files (:func:`manifest`).

The cells' bounds are approximate quantiles over all rows; text columns are compared by the
first seven bytes after what all values begin with. Only the columns that decide the order are
shuffled, in ranges, so no curve cell is too large for a task; rows that agree in place and id
are in the order of the written table. Nulls lie in the first cell. Repeated rows are rows of
their own; an empty table gives an empty table.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import fresh
from assayer.operators.positions import with_position

#: Bits for each column: the number of cells is a power of two.
BITS = 6
_ACCURACY = 10_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve of points with ``bits``-bit coordinates (rows x columns)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    # From the highest bit down: undo the turns and reflections of the cell that a point is in.
    for bit in range(bits - 1, 0, -1):
        q = np.uint64(1 << bit)
        low = q - one
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    # Gray code of what is left.
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flips = np.where((x[-1] >> np.uint64(bit)) & one != 0, flips ^ np.uint64((1 << bit) - 1), flips)
    x ^= flips
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = place << one | (x[i] >> np.uint64(bit)) & one
    return place


def _number(df: DataFrame, name: str) -> Column:
    """A number in the order of the column's values."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if not isinstance(kind, T.StringType):
        return F.col(name).cast("double")
    least, most = df.agg(F.min(name), F.max(name)).first()
    shared = len(os.path.commonprefix([(least or "").encode(), (most or "").encode()]))
    rest = F.hex(F.substring(F.col(name).cast("binary"), shared + 1, 7))
    return F.when(F.col(name).isNotNull(), F.conv(F.rpad(rest, 14, "0"), 16, 10).cast("double"))


def _curve(bounds: list[list[float]], numbers: Sequence[str], place: str, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((len(batch), len(numbers)), np.int64)
            for i, name in enumerate(numbers):
                values = batch.column(name).to_numpy(zero_copy_only=False)
                known = ~np.isnan(values)
                cells[known, i] = np.searchsorted(bounds[i], values[known], "right")
            names = [n for n in batch.schema.names if n not in numbers]
            column = pa.array(hilbert_index(cells, bits).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, place])

    return run


def with_curve(df: DataFrame, dimensions: Sequence[str], place: str = "curve", bits: int = BITS) -> DataFrame:
    """``df`` with its rows' places on the curve; a column named ``place`` is replaced."""
    if len(dimensions) * bits > 63:
        raise ValueError("The curve's index must fit into 63 bits")
    df = df.drop(place) if place not in dimensions else df
    numbers = [fresh(f"_number_{i}", df.columns) for i in range(len(dimensions))]
    numbered = df.select("*", *(_number(df, d).alias(n) for d, n in zip(dimensions, numbers)))
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    quantiles = numbered.agg(*(F.percentile_approx(n, shares, _ACCURACY).alias(n) for n in numbers)).first()
    bounds = [sorted(quantiles[n] or []) for n in numbers]
    place_field = T.StructField(place, T.LongType())
    return numbered.mapInArrow(_curve(bounds, numbers, place, bits), T.StructType([*df.schema.fields, place_field]))


def shard(
    df: DataFrame, dimensions: Sequence[str], order: Sequence[str], n_shards: int, bits: int = BITS
) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (from 0 in each shard); such columns are replaced.

    Rows are in the order of the curve, and of ``order`` at the same place on it; the shards'
    row counts differ by one at most.
    """
    df = df.drop("shard", "slot")
    place, position = fresh("_curve", df.columns), fresh("_position", df.columns)
    placed = with_curve(df, dimensions, place, bits)
    numbered = with_position(placed, [place, *order], name=position)
    n = max(numbered.count(), 1)
    at = f"`{position}` * {n_shards}L div {n}L"
    first = f"(({at}) * {n}L + {n_shards - 1}L) div {n_shards}L"
    return numbered.select(
        *df.columns, F.expr(at).cast("int").alias("shard"), F.expr(f"`{position}` - {first}").alias("slot")
    )


def manifest(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """One row per shard: rows, and the least and largest value of each dimension, to skip files by."""
    ends = [f(d).alias(f"{name}_{d}") for d in dimensions for name, f in (("min", F.min), ("max", F.max))]
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), *ends)


def write_shards(rows: DataFrame, path: str) -> None:
    """Parquet with one folder per shard, rows in the order of their slots; large shards take several files."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
