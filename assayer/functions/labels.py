"""Class labels as numeric ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.text import python_text, strip

UNKNOWN = -1


@dataclass(frozen=True)
class LabelMap:
    """Labels with their ids, in id order."""

    entries: tuple[tuple[int, str], ...]

    @classmethod
    def of(cls, spec: Sequence[str] | Mapping) -> LabelMap:
        """From a list (position is the id) or a mapping in either direction.

        A mapping has a number and a text in every entry; of entries with one id the last
        holds.
        """
        pairs = spec.items() if isinstance(spec, Mapping) else enumerate(spec)
        named = dict(_id_and_label(pair) for pair in pairs)
        if not named:
            raise ValueError("A label map must pair ids with labels")
        return cls(tuple(sorted(named.items())))

    @property
    def ids(self) -> dict[str, int]:
        return {label.lower(): id_ for id_, label in self.entries}


def _id_and_label(pair: tuple) -> tuple[int, str]:
    numbers = [x for x in pair if isinstance(x, (int, float))]
    texts = [x for x in pair if isinstance(x, str)]
    if len(numbers) != 1 or len(texts) != 1:
        raise ValueError(f"A label map must pair ids with labels, not {pair}")
    return int(numbers[0]), texts[0]


def prediction_id(prediction: Column, labels: LabelMap) -> Column:
    """Exact label, else the first label contained in the text, else an integer, else -1."""
    text = strip(F.coalesce(prediction.cast("string"), F.lit("None")))
    lowered = F.lower(text)
    ids = labels.ids
    contained = F.coalesce(
        *(F.when(lowered.contains(label), F.lit(id_).cast("long")) for label, id_ in _ordered(labels))
    )
    integer = F.when(
        text.rlike(r"\A[+-]?\d+(_\d+)*\z"), F.translate(text, "_", "").try_cast("long")
    )
    return F.coalesce(_lookup(lowered, ids), contained, integer, F.lit(UNKNOWN).cast("long"))


def reference_id(reference: Column, dtype: T.DataType, labels: LabelMap) -> Column:
    """A known numeric id as it is (truncated), else the id of the label text, else -1."""
    by_text = _lookup(F.lower(strip(python_text(reference, dtype))), labels.ids)
    known = [id_ for id_, _ in labels.entries]
    candidates = [by_text, F.lit(UNKNOWN).cast("long")]
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        number = reference.try_cast("long")
        candidates.insert(0, F.when(number.isin(known), number))
    return F.coalesce(*candidates)


def _ordered(labels: LabelMap) -> list[tuple[str, int]]:
    ids = labels.ids
    return [(label.lower(), ids[label.lower()]) for _, label in labels.entries]


def _lookup(text: Column, ids: Mapping[str, int]) -> Column:
    table = F.create_map(*(F.lit(x) for label, id_ in ids.items() for x in (label, id_)))
    return F.try_element_at(table, text).cast("long")
