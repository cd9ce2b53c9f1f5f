"""Custom loaders whose shards are read where tasks run, and rows of mixed shape.

A loader that gives an object with ``shards()`` (a list of anything that can be pickled) and
``rows(shard)`` (mappings) is read by one task per shard, so no row passes the driver. Rows are kept
as they are in a table in the shared folder. Their schema is found over all of them: each task merges
the shapes of its rows into one, and only these meet on the driver. A key that first appears in the
last row is a column like the others.
"""

from __future__ import annotations

import datetime
import importlib
import json
import pickle
from base64 import b64decode, b64encode
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce
from itertools import islice
from typing import Any, Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type

from assayer.session import materialize, new_path

# Rows of a loader without shards pass the driver this many at a time.
SPOOL_ROWS = 10_000

# Rows that a task turns into columns at a time.
_DECODE_ROWS = 2_000

Shape = Any  # a name, or a dictionary with "array" or "struct"


@runtime_checkable
class Sharded(Protocol):
    """What a loader returns if its rows can be read shard by shard."""

    def shards(self) -> Sequence[Any]: ...

    def rows(self, shard: Any) -> Iterable[Mapping[str, Any]]: ...


def named(path: str) -> Any:
    """The object of a dotted path."""
    module, _, name = path.rpartition(".")
    return getattr(importlib.import_module(module), name)


class _ShardReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.loader, self.packed = options["loader"], options["dataset"]

    def _loaded(self) -> Sharded:
        return named(self.loader)(pickle.loads(b64decode(self.packed)))

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(shard) for shard in self._loaded().shards()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return ((pickle.dumps(dict(row)),) for row in self._loaded().rows(partition.value))


class ShardSource(DataSource):
    """Pickled rows of a sharded loader, one partition per shard."""

    @classmethod
    def name(cls) -> str:
        return "assayer-shards"

    def schema(self) -> str:
        return "row binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ShardReader(self.options)


def read_shards(spark: SparkSession, dataset: Mapping[str, Any]) -> DataFrame:
    """The rows of a sharded loader, with the schema that is set or else the one that all rows share."""
    spark.dataSource.register(ShardSource)
    options = {"loader": dataset["loader"], "dataset": b64encode(pickle.dumps(dict(dataset))).decode()}
    packed = materialize(spark.read.format(ShardSource.name()).options(**options).load(), "shards")
    return unpacked(packed, dataset.get("schema"))


def read_rows(spark: SparkSession, rows: Iterable[Mapping[str, Any]], schema: str | T.StructType | None = None) -> DataFrame:
    """Any number of rows that the driver iterates over; a few at a time go into the shared folder."""
    path, left = new_path(spark, "loader"), iter(rows)
    chunk = list(islice(left, SPOOL_ROWS))
    if not chunk:
        return spark.createDataFrame([], schema or "struct<>")
    while chunk:
        if schema is None:
            df = spark.createDataFrame([(bytearray(pickle.dumps(dict(row))),) for row in chunk], "row binary")
        else:
            df = spark.createDataFrame(chunk, schema)
        df.write.mode("append").parquet(path)
        chunk = list(islice(left, SPOOL_ROWS))
    stored = spark.read.schema(df.schema).parquet(path)
    return stored if schema is not None else unpacked(stored)


def shape_of(value: Any) -> Shape:
    """The shape of a value: a type's name, {"array": shape} or {"struct": {key: shape}}; "void" fits into all."""
    if isinstance(value, Mapping):
        return {"struct": {str(k): shape_of(v) for k, v in value.items()}} if value else "void"
    if isinstance(value, (list, tuple, set, frozenset)):
        return {"array": reduce(merged, map(shape_of, value), "void")}
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        return "string"
    return next((name for kind, name in _SIMPLE if isinstance(value, kind)), "string")


_SIMPLE = (
    (type(None), "void"), (bool, "boolean"), (int, "bigint"), (float, "double"), (str, "string"), ((bytes, bytearray), "binary"),
    (datetime.datetime, "timestamp"), (datetime.date, "date"),
)


def merged(a: Shape, b: Shape) -> Shape:
    """The least shape that both fit into; what has nothing in common becomes text."""
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    if isinstance(a, dict) and isinstance(b, dict) and a.keys() == b.keys():
        if "array" in a:
            return {"array": merged(a["array"], b["array"])}
        keys = dict.fromkeys([*a["struct"], *b["struct"]])
        return {"struct": {k: merged(a["struct"].get(k, "void"), b["struct"].get(k, "void")) for k in keys}}
    if {str(a), str(b)} == {"bigint", "double"}:
        return "double"
    return "string"


def _type(shape: Shape) -> T.DataType:
    if isinstance(shape, dict) and "array" in shape:
        return T.ArrayType(_type(shape["array"]))
    if isinstance(shape, dict):
        return T.StructType([T.StructField(k, _type(v)) for k, v in sorted(shape["struct"].items())])
    return {"boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType(), "binary": T.BinaryType(),
            "timestamp": T.TimestampType(), "date": T.DateType()}.get(shape, T.StringType())


def fitted(value: Any, kind: T.DataType) -> Any:
    """A value as its column has it; in a column of texts, what is no text is JSON."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: fitted(value.get(f.name), f.dataType) for f in kind} if isinstance(value, Mapping) else None
    if isinstance(kind, T.ArrayType):
        return [fitted(v, kind.elementType) for v in value]
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType) and not isinstance(value, str):
        return json.dumps(value, default=str, ensure_ascii=False)
    return value


def unpacked(packed: DataFrame, schema: str | T.StructType | None = None) -> DataFrame:
    """Stored pickled rows as columns in the order of their names; without a schema all rows tell it."""
    if schema is None:
        shapes = packed.mapInArrow(_shapes, "shape string").collect()
        shape = reduce(merged, (json.loads(r["shape"]) for r in shapes), {"struct": {}})
        schema = _type(shape)
    elif isinstance(schema, str):
        schema = packed.sparkSession.createDataFrame([], schema).schema
    kind = to_arrow_type(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _DECODE_ROWS):
                rows = [fitted(pickle.loads(r), schema) for r in batch.column(0).slice(at, _DECODE_ROWS).to_pylist()]
                yield pa.RecordBatch.from_struct_array(pa.array(rows, kind))

    return packed.mapInArrow(decode, schema) if len(schema) else packed.select()


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per task: the shape that all of its rows fit into."""
    shape: Shape = {"struct": {}}
    for batch in batches:
        for row in batch.column(0).to_pylist():
            own = shape_of(pickle.loads(row))
            shape = merged(shape, own) if own != "void" else shape
    yield pa.RecordBatch.from_pydict({"shape": [json.dumps(shape)]})
