"""Format-string templates compiled once into a ``concat`` expression."""

from __future__ import annotations

import re
from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.fields import resolve_field
from assayer.functions.text import fixed, python_text

TypedColumn = tuple[Column, T.DataType]

_SPEC = re.compile(
    r"(?:(?P<fill>.)?(?P<align>[<>^]))?(?P<zero>0)?(?P<width>\d+)?(?P<comma>,)?"
    r"(?:\.(?P<digits>\d+))?(?P<kind>[sdf%])?"
)


def render_values(template: str, values: Mapping[str, TypedColumn]) -> Column:
    """Fill ``{name}`` placeholders from named columns; ``{{`` and ``}}`` are literal braces."""
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if conversion not in (None, "s"):
            raise ValueError(f"Conversion '!{conversion}' is not supported in templates")
        if name not in values:
            raise KeyError(name)
        column, dtype = values[name]
        if conversion == "s":
            column, dtype = python_text(column, dtype), T.StringType()
        parts.append(_formatted(column, dtype, spec) if spec else python_text(column, dtype))
    return F.concat(*parts) if parts else F.lit("")


def render(
    schema: T.StructType,
    template: str,
    mappings: Mapping[str, str],
    extras: Mapping[str, TypedColumn] | None = None,
    root: Column | None = None,
) -> Column:
    """Fill a template from the row: mapped paths first, extras override them.

    With ``root`` the paths are read from that struct column, which has ``schema``.
    """
    values = {name: resolve_field(schema, path, root) for name, path in mappings.items()}
    values.update(extras or {})
    return render_values(template, values)


def _formatted(column: Column, dtype: T.DataType, spec: str) -> Column:
    match = _SPEC.fullmatch(spec)
    if not match:
        raise ValueError(f"Format spec '{spec}' is not supported in templates")
    kind, digits = match["kind"], match["digits"]
    numeric = isinstance(dtype, T.NumericType)
    if (kind in ("d", "f", "%") or match["comma"]) and not numeric:
        raise ValueError(f"Format spec '{spec}' needs a number, not {dtype.simpleString()}")
    if kind == "d" and not isinstance(dtype, T.IntegralType):
        raise ValueError(f"Format spec '{spec}' needs an integer")
    if kind == "%":
        places = int(digits) if digits else 6
        text = F.concat(fixed(column * 100, places, bool(match["comma"])), F.lit("%"))
    elif kind == "f":
        text = fixed(column, int(digits) if digits else 6, bool(match["comma"]))
    elif numeric and digits:
        raise ValueError(f"Format spec '{spec}' needs the type 'f'")
    elif match["comma"]:
        if not isinstance(dtype, T.IntegralType):
            raise ValueError(f"Format spec '{spec}' needs the type 'f'")
        text = F.format_number(column, 0)
    else:
        text = python_text(column, dtype)
        if digits:
            text = F.substr(text, F.lit(1), F.lit(int(digits)))
    if match["width"]:
        text = _padded(text, match, numeric, column)
    failure = F.raise_error(F.lit(f"None cannot take the format spec '{spec}'")).cast("string")
    return F.when(column.isNotNull(), text).otherwise(failure)


def _padded(text: Column, match: re.Match, numeric: bool, column: Column) -> Column:
    width = int(match["width"])
    missing = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    if match["zero"] and not match["align"]:
        zeros = F.repeat(F.lit("0"), missing)
        if not numeric:
            return F.concat(text, zeros)
        negative = text.startswith("-")
        return F.when(negative, F.concat(F.lit("-"), zeros, F.substr(text, F.lit(2)))).otherwise(
            F.concat(zeros, text)
        )
    fill = F.lit(match["fill"] or ("0" if match["zero"] else " "))
    align = match["align"] or (">" if numeric else "<")
    if align == "^":
        left = F.floor(missing / 2).cast("int")
        return F.concat(F.repeat(fill, left), text, F.repeat(fill, missing - left))
    padding = F.repeat(fill, missing)
    return F.concat(padding, text) if align == ">" else F.concat(text, padding)
