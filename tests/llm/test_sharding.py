"""The curve visits neighbours, the shards are even, and files can be skipped."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import sharding


@pytest.mark.parametrize("bits,n", [(1, 2), (3, 2), (2, 3), (1, 4)])
def test_curve_moves_one_step_at_a_time(bits, n):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    place = sharding.hilbert_index(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards_are_even_and_gapless(spark):
    df = spark.range(1003).select(
        F.when(F.col("id") % 100 == 3, None).otherwise(F.floor(F.col("id") / 3)).alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
        F.hash("id").alias("n"), F.lit(1).alias("slot"), F.lit("x").alias("_curve"),
    )
    rows = sharding.shard(df, ["source", "n", "doc_id"], ["doc_id"], 40)
    assert rows.columns == ["doc_id", "source", "n", "_curve", "shard", "slot"]
    got = rows.collect()
    assert len(got) == 1003
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(40))
    assert {len(s) for s in slots.values()} <= {25, 26}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_filters_skip_shards(spark):
    df = spark.range(20_000).select(F.pmod(F.hash("id"), F.lit(1000)).alias("a"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("b"))
    files = sharding.manifest(sharding.shard(df, ["a", "b"], ["a", "b"], 64), ["a", "b"]).collect()
    assert sum(r["rows"] for r in files) == 20_000
    for name in ("a", "b"):
        assert sum(r[f"min_{name}"] <= 500 <= r[f"max_{name}"] for r in files) <= 24


def test_written_shards(spark, tmp_path):
    rows = sharding.shard(spark.range(100).selectExpr("id", "string(id) s"), ["id", "s"], ["id"], 5)
    sharding.write_shards(rows, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["id"], r["shard"]) for r in back.collect()) == sorted((r["id"], r["shard"]) for r in rows.collect())


def test_empty_table(spark):
    rows = sharding.shard(spark.range(0).selectExpr("id", "string(id) s"), ["id", "s"], ["id"], 5)
    assert rows.columns == ["id", "s", "shard", "slot"] and rows.collect() == []
