"""Task datasets and corpora, by table name, path, file corpus or custom loader."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from assayer.functions.text import java_pattern, python_text
from assayer.sources import loaders
from assayer.sources.files import read_corpus

DEFAULT_SPLIT = "validation"

# Settings of a dataset that is a table or a path; ``kwargs`` of a data hub have no meaning here.
_SETTINGS = frozenset(("name", "path", "format", "options", "schema", "split", "split_column", "filter"))

# Settings of a file corpus.
_FILE_SETTINGS = frozenset(
    "type name path paths glob extensions recursive chunk_size chunk_overlap include_metadata json_content_key json_path json_jq_schema".split()
)

# Place of a row in its dataset, where the files tell it.
FILE_ORDER = ("_file", "_file_row")

# Where the split of the file begins that a row was read from.
FILE_SPLIT = "_file_split"


def load(
    spark: SparkSession,
    dataset: str | Mapping[str, Any],
    split: str | None = None,
    with_order: bool = False,
) -> DataFrame:
    """A dataset as a DataFrame.

    A text is a table name or a path. A mapping has ``name`` or ``path`` (with ``format``
    and ``options``), or ``type: custom`` with a dotted ``loader``, or ``type: files``.
    The split is the mapping's, else ``split``, else ``validation``: it fills ``{split}``
    in the path, or selects the ``split`` column (``split_column`` names another), which
    prunes partitions when the data is partitioned by it. A split that is named but can do
    neither is an error; the default then means all rows. ``with_order`` adds the columns
    of ``FILE_ORDER`` and ``FILE_SPLIT`` to Parquet files.
    """
    if isinstance(dataset, str):
        return _read(spark, dataset, {}, split, with_order)
    if not isinstance(dataset, Mapping):
        raise ValueError("A dataset is given as text or as a mapping")
    kind = dataset.get("type")
    if kind == "custom":
        return _custom(spark, dataset)
    if kind == "files":
        unknown = sorted(set(dataset) - _FILE_SETTINGS)
        if unknown:
            raise ValueError(f"A file corpus has no settings {', '.join(unknown)}")
        return read_corpus(spark, dataset)
    unknown = sorted(set(dataset) - _SETTINGS)
    if unknown:
        raise ValueError(f"A dataset has no settings {', '.join(unknown)}")
    location = dataset.get("name") or dataset.get("path")
    if not location:
        raise ValueError("A dataset needs a name or a path")
    df = _read(spark, location, dataset, dataset.get("split", split), with_order)
    rule = dataset.get("filter") or {}
    if rule.get("column") and rule.get("pattern"):
        df = regex_filter(df, rule["column"], rule["pattern"])
    return df


def regex_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose value, as text, contains a match; an absent column counts as ''."""
    if column in df.columns:
        text = python_text(F.col(f"`{column}`"), df.schema[column].dataType)
    else:
        text = F.lit("")
    return df.where(text.rlike(java_pattern(pattern)))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """``df`` (with the columns of ``FILE_ORDER``) from its first files alone, as many as hold ``n`` rows.

    Rows are counted after all filters, and without one the files' footers tell them; a few more files are
    opened at a time, the others never.
    """
    place = F.col(FILE_ORDER[0])
    # Local paths are spelled with one slash in front where rows tell their file.
    paths = sorted("file:/" + p.removeprefix("file:").lstrip("/") if p.startswith("file:") else p for p in df.inputFiles())
    taken = 1
    while taken < len(paths) and df.where(place.isin(paths[:taken])).count() < n:
        taken *= 4
    return df if taken >= len(paths) else df.where(place.isin(paths[:taken]))


def _read(
    spark: SparkSession, location: str, options: Mapping[str, Any], split: str | None, with_order: bool
) -> DataFrame:
    if "/" not in location and "format" not in options:
        return _of_split(spark.table(location), options, split)
    fmt = options.get("format", "parquet")
    reader = spark.read.format(fmt).options(**options.get("options", {}))
    if "schema" in options:
        reader = reader.schema(options["schema"])
    df = reader.load(location.replace("{split}", split or DEFAULT_SPLIT))
    if with_order and fmt == "parquet":
        place = {
            FILE_ORDER[0]: F.col("_metadata.file_path"),
            FILE_ORDER[1]: F.col("_metadata.row_index"),
            FILE_SPLIT: F.col("_metadata.file_block_start"),
        }
        df = df.select("*", *(c.alias(name) for name, c in place.items()))
    return df if "{split}" in location else _of_split(df, options, split)


def _of_split(df: DataFrame, options: Mapping[str, Any], split: str | None) -> DataFrame:
    column = options.get("split_column", "split")
    if column in df.columns:
        return df.where(F.col(column) == (split or DEFAULT_SPLIT))
    if split:
        raise ValueError(f"The split '{split}' was asked for, but there is neither a column '{column}' nor {{split}} in the path")
    return df


def _custom(spark: SparkSession, dataset: Mapping[str, Any]) -> DataFrame:
    """What a loader returns: a DataFrame, a Python data source class, shards that tasks read, or rows."""
    data = loaders.named(dataset["loader"])
    if isinstance(data, type) and issubclass(data, DataSource):
        spark.dataSource.register(data)
        return spark.read.format(data.name()).options(**dataset.get("options", {})).load()
    rows = data(dataset)
    if isinstance(rows, DataFrame):
        return rows
    if isinstance(rows, loaders.Sharded):
        return loaders.read_shards(spark, dataset)
    return loaders.read_rows(spark, rows, dataset.get("schema"))
