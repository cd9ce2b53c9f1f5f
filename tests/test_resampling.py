"""Resampled means: the same in any partitioning, close to drawing with replacement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators.resampling import bootstrap, weights


def test_weights_are_those_of_a_poisson_variable():
    found = weights(np.arange(-500, 2500), 400)
    assert found.mean() == pytest.approx(1, abs=0.01) and found.var() == pytest.approx(1, abs=0.02)
    shares = np.bincount(found.ravel(), minlength=5)[:5] / found.size
    assert shares == pytest.approx([0.3679, 0.3679, 0.1839, 0.0613, 0.0153], abs=0.004)
    # Neither examples nor replicates go together.
    for side in (found[:300], found.T[:300]):
        related = np.corrcoef(side)
        assert np.abs(related[~np.eye(300, dtype=bool)]).mean() < 0.06
    assert np.array_equal(weights(np.array([7, 9]), 50), weights(np.arange(12), 50)[[7, 9]])


def test_intervals(spark):
    random = np.random.default_rng(4)
    values = random.exponential(size=800)
    rows = [("m", i, float(v)) for i, v in enumerate(values)] + [("few", 0, 2.0), ("few", 1, None), ("few", None, 1.0), ("few", 2, float("nan")), (None, 5, 1.5)]
    df = spark.createDataFrame(rows, "model string, idx long, score double")
    found = {r["model"]: r for r in bootstrap(df.repartition(7), ["model"], "idx", "score").collect()}
    again = {r["model"]: r for r in bootstrap(df.coalesce(1), ["model"], "idx", "score").collect()}
    means = [random.choice(values, 800).mean() for _ in range(2000)]
    m = found["m"]
    assert (m["mean"], m["n"]) == (pytest.approx(values.mean()), 800)
    assert [m["low"], m["median"], m["high"]] == pytest.approx(np.quantile(means, [0.025, 0.5, 0.975]), abs=0.02)
    for name, r in found.items():
        assert [again[name][c] for c in ("mean", "median", "low", "high", "n")] == pytest.approx([r[c] for c in ("mean", "median", "low", "high", "n")])
    assert (found["few"]["low"], found["few"]["high"], found["few"]["n"], found[None]["median"]) == (2.0, 2.0, 1, 1.5)
    assert bootstrap(df.limit(0), ["model"], "idx", "score").collect() == []
    whole = bootstrap(df.where("model = 'm'"), [], "idx", "score").first()
    assert whole["median"] == pytest.approx(m["median"]) and whole["n"] == 800


def test_one_row_per_task_group_and_replicate(spark):
    df = spark.range(5000, numPartitions=3).select(F.lit("m").alias("model"), "id", (F.col("id") % 2).alias("score"))
    found = bootstrap(df, ["model"], "id", "score", replicates=10)
    assert found.first()["n"] == 5000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
