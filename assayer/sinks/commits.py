"""Tables made range by range, each range committed once, whole after any restart.

A table holds results for rows that are numbered by ``idx``. A finished range lies in a folder of its
own and counts from the moment its record is in the log beside it (a file that Spark's committer moves
into place at once). A record says which numbers the range covers, a digest of the rows it was made
from, and the settings it was made with; so a range whose rows or settings have changed since is made
anew, and everything else is kept, whatever the sizes of batches and jobs were. Folders without a
record, left by a job that was stopped, are never read.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hidden from a plain read of the table.
LOG = "_commits"

# Jobs that a table is written in at most, per run.
PARTS = 100

_SCHEMA = "first long, last long, rows long, digest string, settings string, made_with string, at long, folder string"


class Commit(NamedTuple):
    """Rows first ... last of a table, made from ``rows`` rows with this digest, in ``folder``."""

    first: int
    last: int
    rows: int
    digest: str
    settings: str
    made_with: str
    at: int
    folder: str


class Stretch(NamedTuple):
    """Rows first ... last as they lie in ``folder``, which is used as a ``whole`` or has others too."""

    first: int
    last: int
    folder: str
    whole: bool


def read_log(spark: SparkSession, path: str) -> list[Commit]:
    """All commits of the table, the earliest first; a driver's list, as jobs write ``PARTS`` of them at most."""
    try:
        rows = spark.read.schema(_SCHEMA).json(f"{path}/{LOG}").where("folder IS NOT NULL").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((Commit(*r) for r in rows), key=lambda c: (c.at, c.folder))


def _commit(spark: SparkSession, path: str, entry: Commit) -> None:
    spark.createDataFrame([tuple(entry)], _SCHEMA).coalesce(1).write.mode("append").json(f"{path}/{LOG}")


def _hashed(rows: DataFrame) -> Column:
    """A number that follows the content of a row."""
    fields = (F.to_json(f"`{f.name}`") if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f"`{f.name}`") for f in rows.schema)
    return F.xxhash64(*fields).cast("decimal(38,0)")


def _digests(rows: DataFrame, ranges: Sequence[tuple[int, int]]) -> list[tuple[int, str]]:
    """Number and digest of the rows in every range, in one pass; ranges may overlap."""
    if not ranges:
        return []
    bounds = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(ranges)))
    covering = F.filter(bounds, lambda r: (r["a"] <= F.col("idx")) & (F.col("idx") <= r["b"]))
    found = rows.select(_hashed(rows).alias("h"), F.explode(F.transform(covering, lambda r: r["i"])).alias("i"))
    by_range = {r["i"]: (r["n"], str(r["h"])) for r in found.groupBy("i").agg(F.count("*").alias("n"), F.sum("h").alias("h")).collect()}
    return [by_range.get(i, (0, "")) for i in range(len(ranges))]


def valid(rows: DataFrame, path: str, settings: str) -> list[Stretch]:
    """What commits hold for ``rows`` as they are now, in the order of their numbers.

    Of commits that overlap (two jobs under one name) the earliest counts, and the later one for the rest.
    """
    log = [c for c in read_log(rows.sparkSession, path) if c.settings == settings]
    held: list[Stretch] = []
    for commit, facts in zip(log, _digests(rows, [(c.first, c.last) for c in log])):
        if facts == (commit.rows, commit.digest):
            free = gaps(commit.first, commit.last, held)
            whole = free == [(commit.first, commit.last)]
            held = sorted(held + [Stretch(a, b, commit.folder, whole) for a, b in free])
    return held


def gaps(first: int, last: int, held: Sequence[Stretch]) -> list[tuple[int, int]]:
    """The ranges between ``first`` and ``last`` that nothing covers."""
    found, at = [], first
    for stretch in held:
        if stretch.first > at:
            found.append((at, min(stretch.first - 1, last)))
        at = max(at, stretch.last + 1)
    if at <= last:
        found.append((at, last))
    return [(a, b) for a, b in found if a <= b]


def _cut(ranges: Sequence[tuple[int, int]], group: int, parts: int) -> list[tuple[int, int]]:
    """The ranges in pieces of whole groups, about ``parts`` of them."""
    length = sum(b - a + 1 for a, b in ranges)
    step = max(-(-length // (group * parts)), 1) * group
    pieces = []
    for a, b in ranges:
        while a <= b:
            end = min(a // group * group + step - 1, b)
            pieces.append((a, end))
            a = end + 1
    return pieces


def complete(
    rows: DataFrame, path: str, finish: Callable[[DataFrame], DataFrame], group: int = 1, parts: int = PARTS, settings: str = "", made_with: str = ""
) -> DataFrame:
    """The table of ``finish`` of all rows: what is committed and still holds is kept, the rest is made.

    ``rows`` has a distinct ``idx`` and is read a few times, so it should be stored. Ranges end where
    ``group`` numbers are full, so that a group is not divided without need.
    """
    spark = rows.sparkSession
    ends = rows.agg(F.min("idx").alias("first"), F.max("idx").alias("last")).first()
    if ends["first"] is None:
        return finish(rows)
    kept = valid(rows, path, settings)
    pieces = _cut(gaps(ends["first"], ends["last"], kept), group, parts)
    for (first, last), (n, digest) in zip(pieces, _digests(rows, pieces)):
        folder = f"part={uuid.uuid4().hex}"
        if n:
            finish(rows.where(F.col("idx").between(first, last))).write.parquet(f"{path}/{folder}")
            _commit(spark, path, Commit(first, last, n, digest, settings, made_with, time.time_ns(), folder))
    if pieces:
        kept = valid(rows, path, settings)
        missing = gaps(ends["first"], ends["last"], kept)
        if any(n for n, _ in _digests(rows, missing)):
            raise RuntimeError(f"Rows have changed while their results were made: {missing}")
    parts = [spark.read.parquet(*(f"{path}/{k.folder}" for k in kept if k.whole))] if any(k.whole for k in kept) else []
    parts += [spark.read.parquet(f"{path}/{k.folder}").where(F.col("idx").between(k.first, k.last)) for k in kept if not k.whole]
    return reduce(DataFrame.unionByName, parts)
