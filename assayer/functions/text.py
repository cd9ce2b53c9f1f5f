"""Text helpers that keep Python's string conventions inside Spark expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Everything str.strip() removes; all such characters lie at or below U+3000.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# Fixed value: token pattern of the overlap metrics.
NON_TOKEN = "[^a-z0-9]+"


def strip(text: Column) -> Column:
    """Remove surrounding whitespace, Unicode spaces and newlines included."""
    return F.btrim(text, F.lit(WHITESPACE))


def overlap_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), NON_TOKEN), "")


def quote_regex(literal: str) -> str:
    """Escape ``literal`` so that a Java regular expression matches it as it is."""
    return "".join(
        c if c.isalnum() or ord(c) > 127 or c == "_" else f"\\{c}" for c in literal
    )


def java_pattern(pattern: str) -> str:
    """A Python regular expression as Java reads it: Unicode classes, named groups without the P."""
    named = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', 'U')}>", pattern)
    named = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\k<{m[1].replace('_', 'U')}>", named)
    return "(?U)" + named


def any_of(choices: list[str]) -> str:
    return "|".join(quote_regex(c) for c in choices)


def fixed(number: Column, digits: int, grouped: bool = False) -> Column:
    """``number`` with ``digits`` decimals, rounded half-even on its exact value."""
    text = F.format_number(number.cast("double"), digits)
    return text if grouped else F.translate(text, ",", "")


def _float_text(number: Column) -> Column:
    """Shortest decimal text: plain from 1e-4 up to 1e16, with exponent outside."""
    raw = F.abs(number).cast("string")
    mantissa = F.substring_index(raw, "E", 1)
    exponent = F.substring_index(raw, "E", -1).cast("int")
    digits = F.regexp_replace(F.translate(mantissa, ".", ""), "(?<=.)0+$", "")
    width = F.length(digits)
    plain_large = F.when(
        width <= exponent + 1,
        F.concat(digits, F.repeat(F.lit("0"), exponent + 1 - width), F.lit(".0")),
    ).otherwise(
        F.concat(
            F.substr(digits, F.lit(1), exponent + 1), F.lit("."), F.substr(digits, exponent + 2)
        )
    )
    scientific = F.concat(
        F.regexp_replace(mantissa, "\\.0$", ""),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(exponent).cast("string"),
    )
    magnitude = (
        F.when(F.isnan(number), F.lit("nan"))
        .when(raw == "Infinity", F.lit("inf"))
        .when(~raw.contains("E"), raw)
        .when(exponent.between(0, 15), plain_large)
        .when(exponent == -4, F.concat(F.lit("0.000"), digits))
        .otherwise(scientific)
    )
    negative = (number < 0) | (number.cast("string").startswith("-"))
    return F.when(negative & ~F.isnan(number), F.concat(F.lit("-"), magnitude)).otherwise(magnitude)


def python_text(value: Column, dtype: T.DataType) -> Column:
    """The text Python's ``str`` gives for a value; NULL becomes ``None``."""
    if isinstance(dtype, T.StringType):
        text = value
    elif isinstance(dtype, T.BooleanType):
        text = F.when(value, F.lit("True")).when(~value, F.lit("False"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = _float_text(value)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        raise ValueError(
            f"A {dtype.simpleString()} has no text form here; name one of its elements by path."
        )
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("None"))


def text_steps(texts: pa.Array, rows: int, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` texts with about ``size`` bytes together, one text at least, whatever an Arrow batch holds."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = min(max(int(np.searchsorted(ends, before + size, side="right")), first + 1), first + rows, len(texts))
        yield first, last
        first = last


def token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The tokens of lower-cased texts, side by side: the row and the number of each, and what the numbers stand for.

    A batch is cut in one step, and whatever is done with a token is done once for each that is distinct.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern_regex(texts, NON_TOKEN)
    rows = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if "" in names:
        solid = codes != names.index("")
        rows, codes = rows[solid], codes[solid]
    return rows, codes, names
