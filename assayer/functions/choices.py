"""Reading one of a fixed set of choices out of free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.reasoning import Delimiters, split_reasoning
from assayer.functions.text import any_of, strip

# The three places a choice is looked for, most reliable first.
TAGGED = r"<answer>\s*({choices})\s*</answer>"
TRAILING = r"\b({choices})\b\s*$"
ANNOUNCED = r"(?:answer|choice|option)\s*(?:is)?\s*[:=]?\s*({choices})"

# Case-insensitive, with Unicode letters, word boundaries and spaces.
_FLAGS = "(?iuU)"


def extract_choice(text: Column, choices: Sequence[str], default: str | None = None) -> Column:
    """The choice named in ``text``, spelled as listed; ``default`` if there is none."""
    if not choices:
        raise ValueError("The list of choices is empty")
    group = any_of(choices)
    found = F.coalesce(
        *(
            F.nullif(F.regexp_extract(text, _FLAGS + place.replace("{choices}", group), 1), F.lit(""))
            for place in (TAGGED, TRAILING, ANNOUNCED)
        )
    )
    spelling = {choice.upper(): choice for choice in choices}
    listed = F.create_map(*(F.lit(s) for pair in spelling.items() for s in pair))
    return F.coalesce(F.try_element_at(listed, F.upper(found)), F.lit(default or choices[0]))


def constrained_pattern(choices: Sequence[str]) -> str:
    """The pattern that outputs restricted to ``choices`` follow."""
    if not choices:
        raise ValueError("The list of choices is empty")
    return f"({any_of(choices)})"


def is_constrained(text: Column, choices: Sequence[str]) -> Column:
    """Whether the whole text is one of the choices."""
    return text.rlike(rf"\A{constrained_pattern(choices)}\z")


def postprocess(
    prediction: Column,
    choices: Sequence[str] = (),
    default: str | None = None,
    delimiters: Delimiters | None = None,
    strip_reasoning: bool = False,
) -> Column:
    """A completion as it enters scoring: reasoning cut, trimmed, reduced to a choice."""
    text = F.coalesce(prediction.cast("string"), F.lit("None"))
    delimiters = delimiters or Delimiters()
    if strip_reasoning or delimiters.strip_from_prediction:
        text = split_reasoning(text, delimiters).getField("answer")
    text = strip(text)
    return extract_choice(text, choices, default) if choices else text
