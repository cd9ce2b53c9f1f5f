"""Running model plug-ins over prompts, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A generator maps a batch of prompts to completions, or to (completions, raw outputs).
Generator = Callable[..., "list[str] | tuple[list[str], list[str]]"]
# A scorer maps a batch of prompts and the choices to one list of scores per prompt.
Scorer = Callable[..., "list[list[float]]"]

# Marks of the two-phase prompts, used where the task names none.
THINKING_START = "<think"
THINKING_END = "</think"
ANSWER_MARK = "<answer>"


def _lists(prompts: pa.Array, batch_size: int | None) -> Iterator[list[str]]:
    """The prompts of an Arrow batch in lists for a plug-in; only one list at a time is made of Python strings."""
    size = batch_size or max(len(prompts), 1)
    for at in range(0, len(prompts), size):
        yield prompts.slice(at, size).to_pylist()


def _strings(texts: Sequence[str | None]) -> pa.Array:
    return pa.array(list(texts), pa.string())


def generate(
    prompt: Column,
    load: Callable[[], Generator],
    batch_size: int | None = None,
    settings: Mapping[str, Any] | None = None,
) -> Column:
    """A struct ``(completion, raw)`` per prompt.

    ``load`` runs once per Python worker; ``settings`` go to every call as keywords. Prompts reach the generator in lists of at most
    ``batch_size``; without one, a list is one Arrow batch. Where the generator returns no
    raw output, raw is the completion. The call counts as nondeterministic, so that no
    rewrite of the plan runs a model twice.
    """

    @F.arrow_udf("completion string, raw string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        generator = load()
        for prompts in batches:
            for batch in _lists(prompts, batch_size):
                output = generator(batch, **(settings or {}))
                texts, raw = output if isinstance(output, tuple) else (output, output)
                yield pa.StructArray.from_arrays([_strings(texts), _strings(raw)], names=["completion", "raw"])

    return run.asNondeterministic()(prompt)


def best_choice(scores: Sequence[Column], choices: Sequence[str]) -> Column:
    """The choice with the highest score; equal scores go to the one listed first."""
    if not choices:
        raise ValueError("The list of choices is empty")
    ranked = F.array(
        *(
            F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(choice).alias("choice"))
            for i, (score, choice) in enumerate(zip(scores, choices))
        )
    )
    return F.array_max(ranked).getField("choice")


def choose(
    prompt: Column,
    choices: Sequence[str],
    load: Callable[[], Scorer],
    batch_size: int | None = None,
    settings: Mapping[str, Any] | None = None,
) -> Column:
    """The highest-scored choice per prompt, from a plug-in scorer; ties as in :func:`best_choice`."""
    if not choices:
        raise ValueError("The list of choices is empty")

    @F.arrow_udf("string")
    def pick(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = load()
        for prompts in batches:
            for batch in _lists(prompts, batch_size):
                found = scorer(batch, choices, **(settings or {}))
                yield _strings([choices[scores.index(max(scores))] for scores in found])

    return pick.asNondeterministic()(prompt)


def thinking_prompt(prompt: Column, start: str = THINKING_START) -> Column:
    """The first prompt of two-phase inference: it opens the reasoning section."""
    return F.concat(prompt, F.lit("\n" + start))


def answer_prompt(
    prompt: Column, thinking: Column, start: str = THINKING_START, end: str = THINKING_END
) -> Column:
    """The second prompt: the reasoning closed, the answer opened."""
    return F.concat(prompt, F.lit("\n"), reasoning_part(thinking, start, end))


def reasoning_part(
    thinking: Column, start: str = THINKING_START, end: str = THINKING_END
) -> Column:
    return F.concat(F.lit(start), thinking, F.lit(f"\n{end}\n{ANSWER_MARK}"))


def stop_strings(configured: Sequence[str], end: str | None = THINKING_END) -> list[str]:
    """The configured stop strings, with the end of the reasoning section among them."""
    stops = list(configured)
    return stops + [end] if end and end not in stops else stops


def two_phase(
    df: DataFrame,
    prompt: str,
    choices: Sequence[str],
    load_generator: Callable[[], Generator],
    load_scorer: Callable[[], Scorer],
    start: str = THINKING_START,
    end: str = THINKING_END,
    batch_size: int | None = None,
    settings: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Reason freely, then answer with one of the choices; adds ``completion`` and ``raw``.

    The first phase is told to stop at the end of the reasoning section.
    """
    settings = dict(settings or {})
    stopping = {**settings, "stop_strings": stop_strings(settings.get("stop_strings", ()), end)}
    thinking = generate(thinking_prompt(F.col(prompt), start), load_generator, batch_size, stopping)
    thought = df.withColumn("_thinking", thinking.getField("completion"))
    asked = answer_prompt(F.col(prompt), F.col("_thinking"), start, end)
    answered = thought.withColumn("completion", choose(asked, choices, load_scorer, batch_size, settings))
    raw = F.concat(reasoning_part(F.col("_thinking"), start, end), F.col("completion"))
    return answered.withColumn("raw", raw).drop("_thinking")
