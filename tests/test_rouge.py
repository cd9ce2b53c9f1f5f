import random
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.operators import rouge
from assayer.operators.metrics import compute
from assayer.operators.rouge import _lcs_positions, _places, lcs_f

CASES = [
    ("the cat sat on the mat", "the cat on the mat", (0.909091, 0.666667, 0.909091, 0.909091)),
    ("a b c\nd e f", "d e f\na b c", (1, 0.8, 0.5, 1)),
    ("Été à Paris", "ete a paris", (0.4, 0, 0.4, 0.4)),
    ("the the the", "the", (0.5, 0, 0.5, 0.5)),
    ("", "x", (0, 0, 0, 0)),
    ("", "", (0, 0, 0, 0)),
]


def test_scores(spark):
    rows = [("m", str(i), 0, p, r) for i, (r, p, _) in enumerate(CASES)]
    scored = spark.createDataFrame(rows, "model string, task string, idx int, prediction string, reference string")
    found = {(r.task, r.metric_name): r.metric_value for r in compute(scored, "rouge").collect()}
    for i, (_, _, expected) in enumerate(CASES):
        names = ("rouge:rouge1", "rouge:rouge2", "rouge:rougeL", "rouge:rougeLsum")
        assert [found[str(i), n] for n in names] == pytest.approx(expected, abs=1e-6)


def test_mean_counts_examples_without_grams(spark):
    rows = [("m", "t", 0, "a b", "a b"), ("m", "t", 1, "a", "a"), ("m", "t", 2, "", ""), ("m", "t", 3, None, "a")]
    scored = spark.createDataFrame(rows, "model string, task string, idx int, prediction string, reference string")
    found = {r.metric_name: r.metric_value for r in compute(scored, "rouge").collect()}
    assert found["rouge:rouge1"] == pytest.approx(0.5)
    assert found["rouge:rouge2"] == pytest.approx(0.25)
    with pytest.raises(ValueError):
        compute(scored, "rouge", rouge_types=["rougeX"])


def table(left, right):
    t = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, a in enumerate(left, 1):
        for j, b in enumerate(right, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a == b else max(t[i - 1][j], t[i][j - 1])
    return t


words = st.lists(st.sampled_from("abcd"), max_size=25)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_longest_common_subsequence_against_the_full_table(left, right):
    t = table(left, right)
    common = t[-1][-1]
    f = 2 * common / (len(left) + len(right)) if common else 0
    assert lcs_f(right, left) == pytest.approx(f)
    # The walk back through the full table, with the same preference among equal paths.
    expected, i, j = set(), len(left), len(right)
    while i and j:
        if left[i - 1] == right[j - 1]:
            expected.add(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    assert _lcs_positions(_places(left), len(left), right) == sum(1 << i for i in expected)


def test_subsequences_of_long_texts_take_little_memory():
    pick = random.Random(8)
    left, right = ([f"w{pick.randint(0, 400)}" for _ in range(20_000)] for _ in range(2))
    places = rouge._places(left)
    tracemalloc.start()
    found = rouge._lcs_positions(places, len(left), right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    last = list(rouge._growth(places, len(left), right))[-1]
    assert found.bit_count() == len(left) - last.bit_count() and peak < 5 << 20


def test_kept_rows_do_not_change_subsequences(monkeypatch):
    pick = random.Random(9)
    for _ in range(100):
        left, right = ([pick.choice("abcd") for _ in range(pick.randint(0, 30))] for _ in range(2))
        found = []
        for bits in (1 << 24, 0):
            monkeypatch.setattr(rouge, "_KEPT_BITS", bits)
            found.append(rouge._lcs_positions(rouge._places(left), len(left), right))
        assert found[0] == found[1]


def test_overlaps_of_batches_are_those_of_pairs():
    pick = random.Random(10)
    texts = [None, "", "...", "a", "a b", "ü b"] + [" ".join(pick.choice(["a", "b", "c-d", "e,f"]) for _ in range(pick.randint(0, 12))) for _ in range(60)]
    left, right = ([pick.choice(texts) for _ in range(200)] for _ in range(2))
    for n, values in zip((1, 2, 3, 4), rouge.overlaps(left, right, (1, 2, 3, 4))):
        assert values.tolist() == pytest.approx([rouge.overlap_f(rouge._tokens(a), rouge._tokens(b), n) for a, b in zip(left, right)])
    assert [len(x) for x in rouge.overlaps([], [], (1, 2))] == [0, 0]


def test_tokens_of_one_pair_at_a_time():
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(200)]
    tracemalloc.start()
    scores = rouge.subsequences(texts, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (scores.to_numpy() == 1).all()
    # All pairs' tokens together would take about 8 MB.
    assert peak < 1_000_000
