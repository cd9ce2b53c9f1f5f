"""Separating a model's reasoning section from its answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.text import strip

MODES = ("after_end", "remove", "before_start", "none")


@dataclass(frozen=True)
class Delimiters:
    """How the reasoning section is marked and what is kept as the answer."""

    start: str | None = None
    end: str | None = None
    mode: str = "after_end"
    keep_delimiters: bool = False
    strip_from_prediction: bool = False


def split_reasoning(text: Column, marks: Delimiters) -> Column:
    """A struct ``(thinking, answer)``; thinking is NULL where a mark is missing."""
    start, end = marks.start, marks.end
    if not start and not end:
        return F.struct(F.lit(None).cast("string").alias("thinking"), text.alias("answer"))
    if start:
        before, body, after = _around_first_start(text, start, end)
    else:
        after = F.substring_index(text, end, -1)
        before = body = F.substr(
            text, F.lit(1), F.length(text) - F.length(after) - F.lit(len(end))
        )
    thinking = body
    if marks.keep_delimiters and end:
        thinking = F.concat(F.lit(start or ""), body, F.lit(end))
    answers = {
        "after_end": after,
        "remove": F.concat(before, after) if start else after,
        "before_start": before,
    }
    marked = F.lit(True)
    for mark in filter(None, (start, end)):
        marked = marked & text.contains(mark)
    return F.struct(
        F.when(marked, strip(thinking)).alias("thinking"),
        F.when(marked, strip(answers.get(marks.mode, text))).otherwise(text).alias("answer"),
    )


def _around_first_start(text: Column, start: str, end: str | None) -> tuple[Column, Column, Column]:
    """The text before the first start mark, the section, and what follows its end mark."""
    at = F.instr(text, start)
    before = F.substr(text, F.lit(1), at - 1)
    rest = F.substr(text, at + len(start))
    if not end:
        return before, rest, F.lit("")
    closes = F.instr(rest, end)
    body = F.when(closes > 0, F.substr(rest, F.lit(1), closes - 1)).otherwise(rest)
    after = F.when(closes > 0, F.substr(rest, closes + len(end))).otherwise(F.lit(""))
    return before, body, after
