"""Metrics over scored examples, one row per model, task and metric.

``scored`` has ``model, task, idx, prediction, reference``. Every metric returns
``model, task, metric_name, metric_value`` with names of the form ``<metric>:<key>``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.text import java_pattern
from assayer.operators import rouge

GROUP = ("model", "task")

Metric = Callable[..., DataFrame]

_metrics: dict[str, Metric] = {}
_adapters: dict[str, Callable[[DataFrame, str, Mapping], DataFrame]] = {}


def register(name: str, metric: Metric) -> None:
    """Make ``metric(scored, **args)`` available under ``name``; a later one replaces it."""
    _metrics[name.lower()] = metric


def register_python(
    name: str,
    partial: Callable[..., Mapping[str, float]],
    final: Callable[[Mapping[str, Column]], Mapping[str, Column]],
) -> None:
    """Register a metric with a Python body.

    ``partial(predictions, references, **args)`` returns sums for one Arrow batch of one
    model and task. Spark adds the sums up, and ``final`` turns them into the values by
    column arithmetic; so no group has to fit into one task.
    """
    register(name, lambda scored, **args: _python_metric(scored, name, partial, final, args))


def compute(scored: DataFrame, name: str, **args) -> DataFrame:
    """The registered metric ``name`` over ``scored``."""
    if name.lower() not in _metrics:
        raise ValueError(f"Unknown metric '{name}'; known: {', '.join(sorted(_metrics))}")
    return _metrics[name.lower()](scored, **args)


def register_adapter(name: str, adapter: Callable[[DataFrame, str, Mapping], DataFrame]) -> None:
    """Let metrics of a job choose ``adapter(scored, metric name, args)`` by name."""
    _adapters[name.lower()] = adapter


def adapters() -> list[str]:
    return sorted(_adapters)


def compute_all(scored: DataFrame, specs: Sequence) -> DataFrame:
    """All metrics of a task, given as names, ``(name, args)`` or ``(name, args, adapter)``.

    ``metric_order`` is the place in the list, by which a later metric replaces an earlier
    one of the same name.
    """
    frames = []
    for order, spec in enumerate(specs):
        name, args, adapter = (spec, {}, "default") if isinstance(spec, str) else (*spec, "default")[:3]
        if adapter.lower() not in _adapters:
            raise ValueError(f"Unknown metric adapter '{adapter}'; known: {', '.join(adapters())}")
        frames.append(_adapters[adapter.lower()](scored, name, args).withColumn("metric_order", F.lit(order)))
    return reduce(DataFrame.unionByName, frames)


def _named(values: DataFrame, metric: str, keys: Sequence[str]) -> DataFrame:
    """Columns ``keys`` as rows of ``metric_name`` and ``metric_value``."""
    pairs = F.array(
        *(F.struct(F.lit(f"{metric}:{k}").alias("n"), F.col(k).cast("double").alias("v")) for k in keys)
    )
    rows = values.select(*GROUP, F.explode(pairs).alias("_m"))
    return rows.select(*GROUP, F.col("_m.n").alias("metric_name"), F.col("_m.v").alias("metric_value"))


def _hit() -> Column:
    return F.col("prediction").eqNullSafe(F.col("reference")).cast("double")


def accuracy(scored: DataFrame, normalize: bool = True) -> DataFrame:
    """Share of examples whose prediction equals the reference; their number without ``normalize``."""
    value = F.avg(_hit()) if normalize else F.sum(_hit())
    return _named(scored.groupBy(*GROUP).agg(value.alias("accuracy")), "accuracy", ["accuracy"])


def exact_match(
    scored: DataFrame,
    ignore_case: bool = False,
    ignore_punctuation: bool = False,
    ignore_numbers: bool = False,
    regexes_to_ignore: Sequence[str] = (),
) -> DataFrame:
    """Share of examples whose texts are equal once what is to be ignored is gone."""
    ignored = [java_pattern(p) for p in regexes_to_ignore]
    shared = {side: F.col(side) for side in ("prediction", "reference")}
    if ignored or ignore_case or ignore_punctuation or ignore_numbers:
        for side, text in shared.items():
            text = text.cast("string")
            for pattern in ignored:
                text = F.regexp_replace(text, pattern, "")
            text = F.lower(text) if ignore_case else text
            text = F.regexp_replace(text, r"\p{Punct}", "") if ignore_punctuation else text
            shared[side] = F.regexp_replace(text, "[0-9]", "") if ignore_numbers else text
    hits = F.avg(shared["prediction"].eqNullSafe(shared["reference"]).cast("double"))
    return _named(scored.groupBy(*GROUP).agg(hits.alias("exact_match")), "exact_match", ["exact_match"])


def label_counts(scored: DataFrame) -> DataFrame:
    """True positives, predicted and expected examples per model, task and label."""
    sides = F.array(
        F.struct(
            F.col("prediction").alias("label"), F.lit(1).alias("predicted"),
            F.lit(0).alias("expected"), _hit().cast("int").alias("hit"),
        ),
        F.struct(
            F.col("reference").alias("label"), F.lit(0).alias("predicted"),
            F.lit(1).alias("expected"), F.lit(0).alias("hit"),
        ),
    )
    return (
        scored.select(*GROUP, F.inline(sides))
        .groupBy(*GROUP, "label")
        .agg(*(F.sum(c).alias(c) for c in ("hit", "predicted", "expected")))
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def precision_recall_f1(scored: DataFrame, average: str = "binary", pos_label=1) -> DataFrame:
    """``precision, recall, f1`` per model and task; an empty denominator gives 0."""
    counts = label_counts(scored)
    if average == "micro":
        counts = counts.groupBy(*GROUP).agg(
            *(F.sum(c).alias(c) for c in ("hit", "predicted", "expected"))
        )
    elif average not in ("macro", "weighted", "binary"):
        raise ValueError(f"Unknown average '{average}'")
    per_label = counts.withColumns(
        {
            "precision": _ratio(F.col("hit"), F.col("predicted")),
            "recall": _ratio(F.col("hit"), F.col("expected")),
            "f1": _ratio(2 * F.col("hit"), F.col("predicted") + F.col("expected")),
        }
    )
    names = ("precision", "recall", "f1")
    if average == "micro":
        return per_label.select(*GROUP, *names)
    if average == "binary":
        positive = F.col("label") == F.lit(pos_label)
        return per_label.groupBy(*GROUP).agg(
            *(F.coalesce(F.max(F.when(positive, F.col(n))), F.lit(0.0)).alias(n) for n in names)
        )
    if average == "weighted":
        total = F.sum("expected")
        return per_label.groupBy(*GROUP).agg(
            *((F.sum(F.col(n) * F.col("expected")) / total).alias(n) for n in names)
        )
    return per_label.groupBy(*GROUP).agg(*(F.avg(n).alias(n) for n in names))


def _prf_metric(name: str) -> Metric:
    return lambda scored, **args: _named(precision_recall_f1(scored, **args), name, [name])


def rouge_scores(
    scored: DataFrame,
    rouge_types: Sequence[str] = ("rouge1", "rouge2", "rougeL", "rougeLsum"),
    use_stemmer: bool = False,
    use_aggregator: bool = True,
) -> DataFrame:
    """Mean ROUGE F-measures over the examples.

    There is no stemmer, and one value per metric, so the other settings are refused; scores
    of single examples come from :mod:`assayer.operators.rouge`.
    """
    if use_stemmer or not use_aggregator:
        raise ValueError("rouge: neither stemming nor scores of single examples are offered")
    unknown = [t for t in rouge_types if t not in ("rougeL", "rougeLsum") and not t[5:].isdigit()]
    if unknown:
        raise ValueError(f"Unknown ROUGE types: {', '.join(unknown)}")
    frames = []
    sizes = [int(t[5:]) for t in rouge_types if t[5:].isdigit()]
    if sizes:
        frames.append((rouge.rouge_n(scored, sizes), [f"rouge{n}" for n in sizes]))
    longest = [t for t in rouge_types if not t[5:].isdigit()]
    if longest:
        frames.append((rouge.rouge_l(scored), longest))
    named = [
        _named(df.groupBy(*GROUP).agg(*(F.avg(k).alias(k) for k in keys)), "rouge", keys)
        for df, keys in frames
    ]
    return reduce(DataFrame.unionByName, named)


def _python_metric(scored: DataFrame, name: str, partial, final, args: Mapping) -> DataFrame:
    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*group, key, float(value))
                for group, part in batch.groupby(list(GROUP), sort=False, dropna=False)
                for key, value in partial(
                    part["prediction"].tolist(), part["reference"].tolist(), **args
                ).items()
            ]
            yield pd.DataFrame(rows, columns=[*GROUP, "_key", "_value"])

    parts = scored.select(*GROUP, "prediction", "reference").mapInPandas(
        sums, "model string, task string, _key string, _value double"
    )
    # One small map of sums per model and task.
    added = parts.groupBy(*GROUP, "_key").agg(F.sum("_value").alias("_value"))
    table = added.groupBy(*GROUP).agg(
        F.map_from_entries(F.collect_list(F.struct("_key", "_value"))).alias("_sums")
    )
    values = final(_Sums())
    return _named(table.select(*GROUP, *(v.alias(k) for k, v in values.items())), name, list(values))


class _Sums(Mapping):
    """The added-up sums by key, as columns; an absent key is 0."""

    def __getitem__(self, key: str) -> Column:
        return F.coalesce(F.try_element_at("_sums", F.lit(key)), F.lit(0.0))

    def __iter__(self):
        return iter(())

    def __len__(self) -> int:
        return 0


# The name that configuration files use for the built-in metrics stands beside our own.
for _name in ("default", "hf"):
    register_adapter(_name, lambda scored, name, args: compute(scored, name, **args))
register("accuracy", accuracy)
register("exact_match", exact_match)
register("rouge", rouge_scores)
for _name in ("precision", "recall", "f1"):
    register(_name, _prf_metric(_name))
