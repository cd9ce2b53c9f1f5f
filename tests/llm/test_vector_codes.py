"""Vector codes against plain k-means in Python integers."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import vector_codes
from assayer.llm.queries import QUERIES
from plain import rows


def slow(vectors, parts=4, entries=256, rounds=4):
    """(code, error) of each row, the codebooks; by trying every entry."""
    cut = [[math.floor(1024 * x) for x in v] for v in vectors]
    size = len(cut[0]) // parts
    cut = [[tuple(v[i * size : (i + 1) * size]) for i in range(parts)] for v in cut]
    books = [[v[i] for v in cut[:entries]] for i in range(parts)]

    def best(part, book):
        squares = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return squares.index(min(squares)), min(squares)

    for _ in range(rounds):
        for i, book in enumerate(books):
            groups = {}
            for v in cut:
                groups.setdefault(best(v[i], book)[0], []).append(v[i])
            for entry, members in groups.items():
                book[entry] = tuple(sum(xs) // len(members) for xs in zip(*members))
    found = [[best(v[i], books[i]) for i in range(parts)] for v in cut]
    return [("".join(f"{i:02x}" for i, _ in f), sum(e for _, e in f)) for f in found], books


def digest(books):
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def test_query(spark, small):
    data = sorted(rows(small, "embeddings"), key=lambda r: r["vec_id"])
    expected, books = slow([r["embedding"] for r in data])
    by_label = {}
    for r, (_, error) in zip(data, expected):
        by_label[r["label"]] = by_label.get(r["label"], 0) + error
    got = QUERIES["op11_vector_codes"](spark, small).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == [
        (r["vec_id"], code, error, by_label[r["label"]], digest(books)) for r, (code, error) in zip(data, expected)
    ]


def test_more_rows_than_entries_and_odd_rows(spark):
    """Ties, repeated rows, null labels and ids, unusable vectors, clashing names; a third of the rows are equal."""
    made = np.random.default_rng(7).integers(-9, 9, (90, 8)) / 8
    data = [(i // 2, made[i % 30].tolist() if i % 3 else [0.5] * 8, i % 4 or None, "x") for i in range(90)]
    bad = [(0, None, 1, "x"), (0, [None] * 8, 1, "x"), (1, [math.nan] + [0.0] * 7, 1, "x"), (1, [math.inf] + [0.0] * 7, 1, "x")]
    data.append((None, [0.25] * 8, 5, None))
    df = spark.createDataFrame([*data, *bad], "vec_id long, embedding array<float>, label int, coded string").repartition(5)
    got, coded, books = vector_codes.encode(df, entries=20, pivots=3)
    assert coded == "coded_" and got.columns == ["vec_id", "label", "coded", "coded_"]
    ordered = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected, slow_books = slow([r[1] for r in ordered], entries=20)
    assert [[tuple(e) for e in b.tolist()] for b in books] == slow_books
    key = lambda r: tuple((x is not None, x) for x in r)
    mine = sorted(((r["vec_id"], r["label"], r["coded_"]["code"].hex(), r["coded_"]["error"]) for r in got.collect()), key=key)
    assert mine == sorted(((r[0], r[2], *e) for r, e in zip(ordered, expected)), key=key)
    totals = vector_codes.with_total(got.select("label", "coded_.error"), "label", "error", "total").collect()
    for r in totals:
        assert r["total"] == sum(e for d, (_, e) in zip(ordered, expected) if d[2] == r["label"])


def test_empty_and_wrong_lengths(spark):
    schema = "vec_id long, embedding array<float>, label int"
    got, coded, _ = vector_codes.encode(spark.createDataFrame([(1, None, 2)], schema))
    assert got.columns == ["vec_id", "label", coded] and not got.collect()
    got, coded, books = vector_codes.encode(spark.createDataFrame([(1, [], 2), (2, [], 2)], schema))
    assert [(r[coded]["code"].hex(), r[coded]["error"]) for r in got.collect()] == [("00000000", 0)] * 2
    with pytest.raises(ValueError, match="cut into 4"):
        vector_codes.encode(spark.createDataFrame([(1, [1.0] * 6, 2)], schema))
    with pytest.raises(Exception, match="not of length 4: vec_id 2"):
        vector_codes.encode(spark.createDataFrame([(1, [1.0] * 4, 2), (2, [1.0] * 8, 2)], schema))


def test_large_numbers_saturate(spark):
    df = spark.createDataFrame([(1, [3e38, -3e38, 0.0, 1.0]), (2, [1e30, -1e30, 0.0, 1.0])], "vec_id long, embedding array<float>")
    got, coded, books = vector_codes.encode(df, entries=1)
    assert books[0].tolist() == [[1 << 29]] and books[1].tolist() == [[-(1 << 29)]]
    assert {r[coded]["error"] for r in got.collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 30), st.integers(1, 6), st.integers(1, 5), st.integers(1, 2000), st.integers(0, 9999))
def test_pruning_keeps_the_nearest(n, size, width, pivots, spread, seed):
    random = np.random.default_rng(seed)
    parts, book = random.integers(-spread, spread, (n, width)), random.integers(-spread, spread, (size, width))
    fixed = vector_codes.choose_pivots(book, pivots)
    stored = vector_codes.distances(parts, fixed).astype(np.float32).astype(np.float64)
    index, square, _ = vector_codes.nearest(parts, stored, book, vector_codes.distances(book, fixed))
    every = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert index.tolist() == every.argmin(axis=1).tolist() and square.tolist() == every.min(axis=1).tolist()


def test_pivots_spare_most_evaluations():
    random = np.random.default_rng(3)
    centres = random.integers(-2000, 2000, (64, 16))
    book = centres + random.integers(-9, 9, centres.shape)
    parts = centres[random.integers(0, 64, 5000)] + random.integers(-9, 9, (5000, 16))
    fixed = vector_codes.choose_pivots(book, 8)
    _, _, evaluated = vector_codes.nearest(parts, vector_codes.distances(parts, fixed), book, vector_codes.distances(book, fixed))
    assert evaluated < 0.25 * len(parts) * len(book)
