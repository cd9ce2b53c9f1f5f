"""Dot-path access to nested values, strict about what is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve_field(
    schema: T.StructType, path: str, root: Column | None = None
) -> tuple[Column, T.DataType]:
    """The expression and the type behind ``path`` (``a.b.0.c``).

    Struct fields and index texts are checked now, against the schema. Map keys and list
    lengths differ by row, so those raise while the query runs instead of giving NULL.
    ``root`` reads the path from that struct column instead of from the row.
    """
    current, dtype = root, schema
    for part in path.split("."):
        if isinstance(dtype, T.StructType):
            if part not in dtype.fieldNames():
                raise KeyError(f"No field '{part}' on the path '{path}'")
            is_row = current is None
            step = F.col(f"`{part}`") if is_row else current.getField(part)
            dtype_next = dtype[part].dataType
            if not is_row:
                step = _present(current, part, path, step, dtype_next)
        elif isinstance(dtype, T.MapType):
            dtype_next = dtype.valueType
            found = F.map_contains_key(current, F.lit(part))
            step = F.when(found, current[part]).otherwise(
                _fail(f"No key '{part}' on the path '{path}'", dtype_next)
            )
        elif isinstance(dtype, T.ArrayType):
            try:
                index = int(part)
            except ValueError:
                raise KeyError(f"'{part}' on the path '{path}' must be a list index") from None
            if index < 0:
                raise IndexError(f"Negative index {index} on the path '{path}'")
            dtype_next = dtype.elementType
            step = F.when(F.size(current) > index, F.get(current, F.lit(index))).otherwise(
                _fail(f"Index {index} is out of range on the path '{path}'", dtype_next)
            )
        else:
            raise KeyError(f"'{part}' on the path '{path}' is below a plain value")
        current, dtype = step, dtype_next
    return current, dtype


def _fail(message: str, dtype: T.DataType) -> Column:
    return F.raise_error(F.lit(message)).cast(dtype)


def _present(parent: Column, part: str, path: str, step: Column, dtype: T.DataType) -> Column:
    return F.when(parent.isNotNull(), step).otherwise(
        _fail(f"'{part}' on the path '{path}' is below a null", dtype)
    )
