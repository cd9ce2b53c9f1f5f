"""Means of resampled examples, in one pass: a mergeable Poisson bootstrap.

In every replicate an example counts as often as a Poisson variable with mean 1 says, which follows from
the numbers of the example and of the replicate alone. So tasks need not know of each other: each adds up
weights and weighted scores per replicate, the sums of all tasks add up, and a run again gives the same.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPLICATES = 1_000

# A prime below 2^31: products of two residues stay within 64 bits.
PRIME = (1 << 31) - 1
_MULTIPLIERS = (48_271, 16_807, 40_014, 40_692)

#: A residue below the k-th threshold stands for a count of at most k.
THRESHOLDS = [int(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12)]

# Weights that a task makes at a time.
_STEP_NUMBERS = 1 << 21


def weights(examples: np.ndarray, replicates: int) -> np.ndarray:
    """How often each example (rows) counts in each replicate (columns)."""
    a, b, c, d = _MULTIPLIERS
    r = np.arange(replicates, dtype=np.int64)[None]
    x = (np.mod(examples.astype(np.int64), PRIME)[:, None] * a + r * b + 1) % PRIME
    x = (x * (x + c) + r) % PRIME
    x = (x * (x + d) + 1) % PRIME
    return np.searchsorted(THRESHOLDS, x * a % PRIME, side="right")


def weight_sql(example: str, replicate: str) -> str:
    """The same weight as a SQL expression over 64-bit integers."""
    a, b, c, d = _MULTIPLIERS
    p = f"CAST({PRIME} AS BIGINT)"
    first = f"(((({example}) % {p} + {p}) % {p}) * {a} + {replicate} * {b} + 1) % {p}"
    steps = f"list_transform([{first}], lambda x: (x * (x + {c}) + {replicate}) % {p})"
    steps = f"list_transform({steps}, lambda x: ((x * (x + {d}) + 1) % {p}) * {a} % {p})"
    counted = " + ".join(f"CAST(x >= {t} AS INTEGER)" for t in THRESHOLDS)
    return f"list_transform({steps}, lambda x: {counted})[1]"


def _replicate_sums(replicates: int, n_keys: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kinds = None
        for batch in batches:
            kinds = [batch.column(i).type for i in range(n_keys)]
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)))) or [()] * len(batch)
            examples = batch.column(n_keys).to_numpy(zero_copy_only=False)
            values = batch.column(n_keys + 1).to_numpy(zero_copy_only=False)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            step = max(_STEP_NUMBERS // replicates, 1)
            for key, rows in places.items():
                total = sums.setdefault(key, np.zeros((2, replicates)))
                for at in range(0, len(rows), step):
                    part = rows[at : at + step]
                    weight = weights(examples[part], replicates).astype(np.float64)
                    total[0] += weight.sum(axis=0)
                    total[1] += values[part] @ weight
        for key, (weight, value) in sums.items():
            columns = [pa.array([k] * replicates, kind) for k, kind in zip(key, kinds)]
            columns += [pa.array(np.arange(replicates, dtype=np.int32)), pa.array(weight), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"key_{i}" for i in range(n_keys)] + ["replicate", "weight", "value"])

    return run


def bootstrap(
    scores: DataFrame, keys: Sequence[str], example: str, value: str, replicates: int = REPLICATES, interval: float = 0.95
) -> DataFrame:
    """Per ``keys``: ``mean, median, low, high, n`` of the scores and of their resampled means.

    ``example`` is a whole number that tells the examples of a group apart. Scores that are null or no
    numbers are left out; a replicate in which no example counts has no mean.
    """
    named = scores.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), F.col(example).cast("long").alias("example"), F.col(value).cast("double").alias("score"))
    named = named.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("example").isNotNull())
    own = [f"key_{i}" for i in range(len(keys))]
    schema = T.StructType([
        *(named.schema[k] for k in own), T.StructField("replicate", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("value", T.DoubleType())
    ])
    sums = named.mapInArrow(_replicate_sums(replicates, len(own)), schema).groupBy(*own, "replicate").agg(F.sum("weight").alias("weight"), F.sum("value").alias("value"))
    means = sums.where("weight > 0").groupBy(*own).agg(
        *(F.percentile(F.col("value") / F.col("weight"), F.lit(q)).alias(name) for name, q in (("low", (1 - interval) / 2), ("median", 0.5), ("high", (1 + interval) / 2)))
    )
    plain = named.groupBy(*own).agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    same = [plain[k].eqNullSafe(means[k]) for k in own] or F.lit(True)
    joined = plain.join(means, same, "left")
    return joined.select(*(plain[k].alias(name) for k, name in zip(own, keys)), "mean", "median", "low", "high", "n")
