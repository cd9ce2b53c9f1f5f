"""Mixtures against plain versions: targets, flows by trying all, documents in the order of their hashes."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from assayer.llm import mixing
from assayer.llm.queries import QUERIES
from plain import rows

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


def slow_targets(sizes, weights=(5, 2, 1), limit=3):
    """source -> target; what is above goes to the others, again and again."""
    ordered = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ordered)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in full)
        shares = sum(weight[s] for s in sizes if s not in full)
        target = {s: float(limit * sizes[s]) if s in full else left * weight[s] / shares for s in sizes}
        more = {s for s in sizes if s not in full and target[s] > limit * sizes[s]}
        if not more:
            return target
        full |= more


def test_query(spark, small):
    docs = rows(small, "documents")
    size = {d["doc_id"]: len(WORDS.findall(d["text"] or "")) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    targets = slow_targets(sizes)
    got = QUERIES["op13_source_mix"](spark, small).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        i = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[i], sizes[source[i]])
        assert r["target"] == pytest.approx(targets[source[i]], rel=1e-9)
        assert r["taken"] in (0, size[i], 2 * size[i], 3 * size[i])
        taken[source[i]] += r["taken"]
    # A source has ten documents here.
    for s, words in taken.items():
        assert abs(words - targets[s]) <= 0.03 * targets[s]
    again = QUERIES["op13_source_mix"](spark, small).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def slow_flow(sizes, members, quotas, costs):
    """(words, cost) of the best flow, by trying all."""
    best = (0, 0)
    choices = [list(itertools.product(range(3 * size + 1), repeat=len(own))) for size, own in zip(sizes, members)]
    for flow in itertools.product(*choices):
        got = [0] * len(quotas)
        for own, words in zip(members, flow):
            for s, n in zip(own, words):
                got[s] += n
        if any(g > q for g, q in zip(got, quotas)) or any(sum(w) > 3 * size for size, w in zip(sizes, flow)):
            continue
        cost = sum(costs[i // size] for size, w in zip(sizes, flow) for i in range(sum(w)))
        best = max(best, (sum(got), -cost))
    return best


def test_flows_are_the_cheapest_of_the_largest():
    pick = random.Random(5)
    for _ in range(150):
        quotas = [pick.randint(0, 5) for _ in range(pick.randint(1, 3))]
        members = [sorted(pick.sample(range(len(quotas)), pick.randint(1, min(2, len(quotas))))) for _ in range(pick.randint(1, 3))]
        sizes = [pick.randint(1, 2) for _ in members]
        flow = mixing.min_cost_flow(sizes, members, quotas)
        given = [sum(n for (p, _), n in flow.items() if p == q) for q in range(len(sizes))]
        cost = sum(mixing.COSTS[i // sizes[p]] for p, n in enumerate(given) for i in range(n))
        got = [sum(n for (_, s), n in flow.items() if s == q) for q in range(len(quotas))]
        assert all(g <= q for g, q in zip(got, quotas)) and all(s in members[p] for p, s in flow)
        assert (sum(given), -cost) == slow_flow(sizes, members, quotas, mixing.COSTS)


SCHEMA = "id long, sources array<string>, size long, mixed string"


def slow_mix(data, flows, limit=3):
    """id -> copies, from (id, pattern, size, place on the line, hash) and pattern -> words."""
    copies = {}
    for pattern, words in flows.items():
        own = sorted((place, h, size, row) for row, p, size, place, h in data if p == pattern)
        length, at, left = sum(size for _, _, size, _ in own), 0, words
        for _, h, size, row in own:
            copies[row] = sum(1 for k in range(limit) if size and k * length + at + size <= words)
            at += size
            left -= size * copies[row]
        for fill in range(mixing.FILLS):
            room = 2 * left - 1 if fill == mixing.FILLS - 1 else left
            fitting = [(-abs(left - size), size, h, row) for _, h, size, row in own if 0 < size <= max(room, left) and copies[row] < limit]
            if fitting:
                _, size, h, row = max(fitting)
                copies[row] += 1
                left -= size
    return copies


@pytest.mark.parametrize("range_rows", [4096, 7])
def test_overlaps_nulls_and_a_hot_pattern(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    pick = random.Random(2)
    kinds = [["a"], ["a", "b"], ["b", "c", "a"], [None], ["d"], [None, "d"], ["z"], [], None, ["y"]]
    data = [(i // 2, kinds[1] if i % 3 == 0 else kinds[i % len(kinds)], pick.choice([None, 0, 1, 5, 9, 40]), "x") for i in range(300)]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    result, mixed, targets = mixing.mix(df, F.col("sources"), F.col("size"), ["id", "size"])
    assert mixed == "mixed_" and result.columns == ["id", "sources", "size", "mixed", "mixed_"]
    got = result.collect()
    key = lambda sources: tuple(sorted(set(sources or []), key=str))
    assert sorted(str((r["id"], key(r["sources"]), r["size"] or 0)) for r in got) == sorted(str((i, key(s), n or 0)) for i, s, n, _ in data)
    sizes = {}
    for _, sources, size, _ in data:
        for s in key(sources):
            sizes[s] = sizes.get(s, 0) + (size or 0)
    told = {r["source"]: (r["source_size"], r["target"]) for r in targets.collect()}
    total = sum(n or 0 for _, _, n, _ in data)
    credited = dict.fromkeys(sizes, 0)
    for r in got:
        m = r["mixed_"]
        assert m["taken"] == (r["size"] or 0) * len(m["credits"]) and m["taken"] <= 3 * (r["size"] or 0)
        assert set(m["credits"]) <= set(r["sources"] or [])
        for s in m["credits"]:
            credited[s] += r["size"]
    assert {s: n for s, (n, _) in told.items()} == sizes
    assert abs(sum(t for _, t in told.values()) - total) < 1e-6
    for s in ("a", "b", "c", "d", None, "z", "y"):
        assert abs(credited[s] - told[s][1]) <= 41
    again = mixing.mix(df, F.col("sources"), F.col("size"), ["id", "size"])[0].collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("range_rows", [4096, 5])
def test_documents_are_those_of_the_plain_version(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    pick = random.Random(4)
    data = [(i, [pick.choice("aaab")], pick.randint(0, 30), "x") for i in range(200)]
    df = spark.createDataFrame(data, SCHEMA)
    result, mixed, targets = mixing.mix(df, F.col("sources"), F.col("size"), ["id"])
    got = {r["id"]: len(r[mixed]["credits"]) for r in result.collect()}
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.lit(mixing.SEED), "id").alias("h")).collect()}
    flows = {r["source"]: min(round(r["target"]), 3 * r["source_size"]) for r in targets.collect()}
    # Ranges are by the hash's first bits, without a sign.
    place = {i: h % (1 << 64) if range_rows == 5 else h for i, h in hashes.items()}
    assert got == slow_mix([(i, s[0], n, place[i], hashes[i]) for i, s, n, _ in data], flows)


def test_empty_and_wordless(spark):
    result, mixed, targets = mixing.mix(spark.createDataFrame([], SCHEMA), F.col("sources"), F.col("size"), ["id"])
    assert result.columns[-1] == mixed and not result.collect() and not targets.collect()
    result, mixed, targets = mixing.mix(spark.createDataFrame([(1, ["a"], 0, "")], SCHEMA), F.col("sources"), F.col("size"), ["id"])
    assert [r[mixed]["taken"] for r in result.collect()] == [0] and [r["target"] for r in targets.collect()] == [0.0]
    with pytest.raises(ValueError, match="patterns of overlapping"):
        mixing.mix(spark.createDataFrame([(1, ["a", "b"], 3, "")], SCHEMA), F.col("sources"), F.col("size"), ["id"], max_patterns=0)
