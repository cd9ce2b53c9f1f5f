"""Repeated byte strings against a plain scan over all windows, and the sorting on its own."""

import os
import random

import numpy as np
import pytest

from assayer.llm import substrings as sub


def slow(rows, length=sub.LENGTH):
    """rows of (doc_id, text) in order: removed byte ranges and kept bytes by the definition."""
    seen, out = set(), []
    for _, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        spans, at = [], 0
        while at < len(data):
            end = at
            while end < len(data) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        out.append((len(data), spans, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def texts(seed, n):
    dice = random.Random(seed)
    words = ["".join(dice.choice("abcdeéß") for _ in range(dice.randint(1, 9))) for _ in range(300)]
    passages = [" ".join(dice.choice(words) for _ in range(dice.randint(10, 60))) for _ in range(8)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(dice.randint(0, 6)):
            kind = dice.random()
            if kind < 0.4:
                parts.append(dice.choice(passages))
            elif kind < 0.5:
                parts.append(dice.choice("ab \n") * dice.randint(1, 400))
            elif kind < 0.6 and rows:
                parts.append((dice.choice(rows) or "")[dice.randint(0, 50) :])
            else:
                parts.append(" ".join(dice.choice(words) for _ in range(dice.randint(1, 80))))
        rows.append(None if dice.random() < 0.03 else " ".join(parts))
    return rows


def run(spark, rows, crowd=sub.CROWD, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return [
        (r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"]))
        for r in sub.remove_repeats(docs, crowd=crowd).collect()
    ]


@pytest.mark.parametrize("seed,crowd", [(1, sub.CROWD), (2, 3), (3, 1)])
def test_against_all_windows(spark, seed, crowd):
    rows = list(enumerate(texts(seed, 120)))
    random.Random(seed).shuffle(rows)
    expected = [(i, *x) for (i, _), x in zip(sorted(rows), slow(sorted(rows)))]
    assert sorted(run(spark, rows, crowd)) == expected


def test_nulls_repeated_ids_and_short_texts(spark):
    long = "".join(random.Random(9).choices("abcdefgh", k=300))
    rows = [(1, long), (1, long), (None, long[:150]), (2, None), (3, ""), (4, "short"), (5, "x" * 250)]
    got = sorted(run(spark, rows), key=str)
    # Null ids come first, so the others lose what the first has; of equal rows one keeps the rest.
    assert sorted(len(k) for i, _, _, k in got if i == 1) == [0, 150]
    assert [x for x in got if x[0] is None] == [(None, 150, [], long[:150].encode())]
    assert [len(k) for i, _, _, k in got if i in (2, 3, 4)] == [0, 0, 5]
    assert [(s, len(k)) for i, _, s, k in got if i == 5] == [([(1, 250)], 1)]


def test_empty_table(spark):
    assert run(spark, []) == []


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sub, "_PIECE", 256)
    data = np.frombuffer("".join(texts(5, 40)[i] or "" for i in range(40)).encode(), np.uint8)
    pieces = list(sub._pieces(np.array([0, len(data)]), 100))
    assert len(pieces) > 5
    starts = [p for row, at, bounds, before in pieces for p in range(before, before + int(bounds[-1]) - 99)]
    assert starts == list(range(len(data) - 99))


def test_blind_tries_sort():
    dice = random.Random(7)
    strings = [b"same" + bytes(dice.choice(b"ab\0") for _ in range(dice.randint(0, 12))) for _ in range(300)]
    order, common = sub.blind_sort(strings, list(range(300)), 4)
    assert [strings[i] for i in order] == sorted(strings)
    pairs = zip(order, order[1:], common[1:])
    assert all(c == len(os.path.commonprefix([strings[a], strings[b]])) for a, b, c in pairs)


def test_deep_shallow_order():
    dice = random.Random(8)
    strings = [bytes(dice.choice(b"ab\0") for _ in range(dice.randint(0, 40))) for _ in range(400)]
    group = np.array([dice.randint(0, 4) for _ in strings])
    order, common = sub.deep_shallow(strings, group, 0, 8)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group, strings))
    for a, b, c in zip(order, order[1:], common[1:]):
        assert c == (len(os.path.commonprefix([strings[a], strings[b]])) if group[a] == group[b] else -1)
