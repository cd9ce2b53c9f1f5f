"""The automaton against all windows, and documents cut where it hits."""

import random
import time

import pytest
from pyspark.sql import functions as F

from assayer.llm import decontamination as dc
from plain import hits, without_hits


def corpus(seed, n_items, n_docs):
    dice = random.Random(seed)
    vocabulary = ["Aa", "b", "c", "é", "d7", "E"]

    def some(k):
        return " ".join(dice.choice(vocabulary) + dice.choice(["", ",", "!", "\n"]) for _ in range(k))

    items = [(dice.choice([i, i, i // 2]), some(dice.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(n_items)]
    docs = []
    for i in range(n_docs):
        parts = [some(dice.randint(0, 40))]
        if dice.random() < 0.5:
            body = dice.choice(items)[1].split(" ")
            parts.append(" ".join(body[dice.randint(0, 3) :]).upper())
        docs.append((i, " - ".join([*parts, some(dice.randint(0, 12))])))
    return items, docs


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_all_windows(seed):
    items, docs = corpus(seed, 12, 30)
    if seed % 2:
        items = [(i, t) for i, t in items if len(dc.words_of(t)) >= 4]
    automaton = dc.SuffixAutomaton([(str(i), dc.words_of(t)) for i, t in items], dc.WINDOW)
    for _, text in docs:
        ranges, names = automaton.match(dc.words_of(text))
        n, hit, found = hits(text, items)
        assert {p for a, b in ranges for p in range(a, b)} == hit
        assert names == {str(i) for i in found}


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_words", [dc.BLOCK_WORDS, 20])
def test_documents(spark, block_words):
    items, docs = corpus(9, 10, 40)
    items = [(i, t) for i, t in items if len(dc.words_of(t)) >= 9]
    docs += [(100, None), (101, ""), (102, "x " * 30_000 + items[0][1] + " y" * 30_000), (103, items[0][1]), (103, items[0][1])]
    table = spark.createDataFrame([(*d, "kept") for d in docs], "doc_id long, text string, found string")
    found = dc.find(table, items_table(spark, items), block_words=block_words).collect()
    expected = {i: hits(t, items) for i, t in docs}
    assert len(found) == len(docs)
    for row in found:
        n, hit, names = expected[row["doc_id"]]
        assert (row["found"]["n_words"], row["found"]["n_hit"]) == (n, len(hit))
        assert row["found"]["item_ids"] == sorted(map(str, names))
    kept = dc.decontaminate(table, items_table(spark, items), block_words=block_words)
    assert kept.columns == table.columns
    assert sorted(map(str, ((r["doc_id"], r["text"], r["found"]) for r in kept.collect()))) == sorted(
        map(str, ((i, without_hits(t, items), "kept") for i, t in docs if t is None or without_hits(t, items) is not None))
    )


def test_items_that_are_null_empty_or_absent(spark):
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, words), (2, "a b")], "doc_id long, text string")
    items = items_table(spark, [(None, words), (5, None), (6, ""), (7, "a b")])
    got = {r["doc_id"]: r["found"] for r in dc.find(docs, items).collect()}
    assert (got[1]["n_hit"], got[1]["item_ids"]) == (12, []) and got[2]["item_ids"] == ["7"]
    nothing = items_table(spark, [])
    assert [r["found"]["n_hit"] for r in dc.find(docs, nothing).collect()] == [0, 0]
    assert dc.decontaminate(docs, nothing).count() == 2
    assert dc.find(docs.where(F.lit(False)), items).collect() == []


def test_repeated_words_take_linear_time():
    start = time.process_time()
    n = 100_000
    items = [("long", [b"a"] * n), ("short", [b"a"] * 3), ("pair", [b"a", b"b"]), ("one", [b"b"])]
    for chosen in (items[:1], items):
        automaton = dc.SuffixAutomaton(chosen, 10)
        ranges, names = automaton.match([b"a"] * n + [b"b"])
        assert ranges == [(0, n + len(chosen) // 4)] and names == {name for name, _ in chosen}
    assert time.process_time() - start < 20


def test_short_items_of_one_state():
    """Items of several lengths that end in the same places."""
    automaton = dc.SuffixAutomaton([("x", [b"b"]), ("y", [b"a", b"b"]), ("z", [b"c", b"a", b"b"])], 10)
    assert automaton.match([b"b"]) == ([(0, 1)], {"x"})
    assert automaton.match([b"a", b"b"]) == ([(0, 2)], {"x", "y"})
    assert automaton.match([b"c", b"a", b"b", b"b"]) == ([(0, 4)], {"x", "y", "z"})
