"""Near-duplicate components against all pairs, and the parts that decide who meets."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import ngram_join as nj
from assayer.llm.common import as_bytes
from plain import linked


def corpus(seed, n):
    dice = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Der", "der", "É", "é"]
    rows = []
    for i in range(n):
        if rows and dice.random() < 0.7:
            base = (dice.choice(rows[-25:]) or "").split(" ")
            for _ in range(dice.choice([0, 0, 1, 1, 2, 3])):
                at = dice.randrange(len(base) + 1)
                base[at : at + dice.randint(0, 2)] = [dice.choice(words) for _ in range(dice.randint(0, 2))]
            rows.append(" ".join(base))
        else:
            rows.append(" ".join(dice.choice(words) for _ in range(dice.choice([0, 1, 2, 3, 9, 30, 70, 200]))))
    rows[3], rows[5] = None, " \n\t "
    return list(enumerate(rows))


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["n_grams"], r["component"]) for r in nj.near_duplicates(docs, **options).collect()}


@pytest.mark.parametrize(
    "seed,crowd,n,percent", [(1, nj.CROWD, 3, 90), (2, 200, 3, 90), (3, nj.CROWD, 5, 80), (4, 400, 2, 80), (5, nj.CROWD, 1, 60), (6, nj.CROWD, 5, 80)]
)
def test_against_all_pairs(spark, seed, crowd, n, percent, monkeypatch):
    monkeypatch.setattr(nj, "PIVOTS", 2)
    rows = corpus(seed, 250)
    assert run(spark, rows, crowd=crowd, n=n, percent=percent) == linked(rows, n, percent)


@pytest.mark.parametrize("percent", [95, 90, 87, 80, 70, 50])
def test_linked_pairs_send_something_in_common(percent):
    dice = random.Random(percent)
    seen = 0
    for _ in range(400):
        size = dice.choice([1, 2, 5, 9, 10, 11, 19, 30, 100, 400])
        base = np.array(dice.sample(range(1 << 40), size * 2), np.uint64)
        most = size * (100 - percent) // percent
        drop, more = dice.choice([(dice.randint(0, most), dice.randint(0, most)), (most // 2, most // 2), (0, most)])
        one, two = base[:size], np.concatenate([base[drop:size], base[size : size + more]])
        both = size - drop
        if len(two) and 100 * both >= percent * (size + len(two) - both):
            seen += 1
            a, b = (set(nj._part_hashes(np.sort(x), percent, 5).tolist()) for x in (one, two))
            assert a & b
            firsts = [set(nj._first_grams(np.sort(x), percent).tolist()) for x in (one, two)]
            needed = -(-max(size, len(two)) * nj._MORE * percent // 10_000)
            assert len(firsts[0] & firsts[1]) >= needed
    assert seen > 100


def test_tree_links_as_all_pairs():
    dice = random.Random(4)
    sets = []
    for _ in range(200):
        base = set(dice.choice(sets).tolist()) if sets and dice.random() < 0.8 else set(dice.sample(range(5000), dice.randint(1, 60)))
        for _ in range(dice.randint(0, 4)):
            base.symmetric_difference_update([dice.randrange(5000)])
        sets.append(np.array(sorted(base or {1}), np.uint64))
    tree = nj.PrefixTree(sets, 90)
    tree.link()
    pairs = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))
    ]
    parent = list(range(len(sets)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        parent[b] = a
    assert [tree.find(i) for i in range(len(sets))] == [find(i) for i in range(len(sets))]
    assert tree.visited < len(sets) ** 2 / 4


def test_sets_keep_to_their_rows():
    data, offsets = as_bytes(pa.array(["a b", "c d e", None, "A  B\x0bC a b c", "x"]))
    sets = nj.ngram_sets(data, offsets, 3)
    assert [len(s) for s in sets] == [1, 1, 0, 3, 1]


def test_repeated_rows_null_ids_and_kept_ones(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text, "x"), (7, text, "y"), (None, text, "z"), (8, "", "x"), (9, None, "x"), (10, "other words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    kept = [(r["doc_id"], r["text"]) for r in nj.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(None, text), (8, ""), (9, None), (10, "other words here")], key=str)
    assert nj.keep_one(docs).columns == docs.columns


def test_empty_table(spark):
    assert run(spark, []) == {}


@pytest.mark.parametrize("sending", [lambda: nj._signatures(5, 80, 0), lambda: nj._send_first(5, 80)])
def test_tasks_pass_on_small_batches(sending):
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(3000)]
    batch = pa.table({"key": pa.array(range(3000), pa.int64()), "block": pa.array([0] * 3000, pa.int64()), "text": texts}).to_batches()
    tracemalloc.start()
    rows = [(len(b), tracemalloc.get_traced_memory()[1]) for b in sending()(iter(batch))]
    tracemalloc.stop()
    assert sum(n for n, _ in rows) > 300_000 and max(n for n, _ in rows) <= 1 << 16
    assert rows[-1][1] < 100_000_000
