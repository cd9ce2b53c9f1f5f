"""Search by bounds: the same hits as by scoring everything, with few blocks visited."""

import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.operators import retrieval
from assayer.operators.block_search import BlockSearch, blocks
from assayer.operators.retrieval import top_k
from test_retrieval import expected, frame, rows


def plain(queries, ids, corpus, k):
    scores = np.round(queries @ corpus.T, 12)
    return {(q, int(ids[i])) for q in range(len(queries)) for i in sorted(range(len(ids)), key=lambda i: (-scores[q, i], ids[i]))[:k]}


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(1, 120), st.integers(1, 5), st.integers(1, 9), st.integers(1, 20), st.integers(0, 9999))
def test_hits_are_those_of_scoring_everything(n, m, width, k, size, seed):
    random = np.random.default_rng(seed)
    queries, corpus = random.integers(-3, 4, (n, width)) / 2, random.integers(-3, 4, (m, width)) / 2
    ids = random.permutation(m)
    search = BlockSearch(queries, k, size=size)
    for part in np.array_split(np.arange(m), 3):
        if len(part):
            search.add(ids[part], corpus[part])
    row, hits, _ = search.hits()
    assert set(zip(row.tolist(), hits.tolist())) == plain(queries, ids, corpus, k)


def clustered(random, n, centres, spread):
    made = centres[random.integers(0, len(centres), n)] + random.normal(size=(n, centres.shape[1])) * spread
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def test_few_blocks_are_visited():
    random = np.random.default_rng(1)
    centres = random.normal(size=(40, 32))
    queries, corpus = clustered(random, 600, centres, 0.05), clustered(random, 16_000, centres, 0.05)
    search = BlockSearch(queries, 3, size=64)
    search.add(np.arange(len(corpus)), corpus)
    assert search.visited < 0.15 * search.possible
    row, hits, _ = search.hits()
    assert set(zip(row.tolist(), hits.tolist())) == plain(queries, np.arange(len(corpus)), corpus, 3)
    # With what a hit must reach known beforehand, even less.
    again = BlockSearch(queries, 3, search.scores[:, -1].copy(), size=64)
    again.add(np.arange(len(corpus)), corpus)
    assert again.visited <= search.visited and np.array_equal(again.ids, search.ids)


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e20])
def test_hits_that_differ_beyond_single_precision(scale):
    random = np.random.default_rng(3)
    queries, middle = random.normal(size=(300, 16)), random.normal(size=(5, 16))
    corpus = middle[random.integers(0, 5, 3000)] * scale + random.normal(size=(3000, 16)) * 1e-8 * scale
    if scale <= 1:
        corpus[2000:2400] = corpus[:400]
    search = BlockSearch(queries, 3, size=20)
    for at in range(0, 3000, 1000):
        search.add(np.arange(at, at + 1000), corpus[at : at + 1000])
    row, hits, _ = search.hits()
    assert set(zip(row.tolist(), hits.tolist())) == plain(queries, np.arange(3000), corpus, 3)


def test_memory_does_not_follow_the_number_of_queries():
    random = np.random.default_rng(4)
    vectors, corpus = random.normal(size=(60_000, 16)), random.normal(size=(512, 16))
    known = np.sort(vectors @ corpus[:64].T, axis=1)[:, -3]
    tracemalloc.start()
    search = BlockSearch(vectors, 3, known)
    search.add(np.arange(len(corpus)), corpus)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A row of distances to all centres for every query would be 112 MB.
    assert peak < 8 * vectors.nbytes


def test_groups_grow_where_scans_would_be_too_many(spark, monkeypatch):
    random = np.random.default_rng(6)
    vectors = random.normal(size=(300, 4)).astype(np.float32)
    scans = []
    written = retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, purpose: (scans.append(purpose), written(df, purpose))[1])
    found = top_k(frame(spark, np.arange(300), vectors, "query_id"), frame(spark, np.arange(300), vectors, "corpus_id"), 2, broadcast_bytes=0, block_rows=3)
    assert rows(found) == expected(np.arange(300), vectors, np.arange(300), vectors, 2)
    assert scans.count("candidates") <= 16


def test_blocks_hold_their_rows():
    random = np.random.default_rng(2)
    vectors = np.vstack([random.normal(size=(500, 6)), np.ones((2000, 6)), np.zeros((3, 6))])
    found = blocks(vectors, 50)
    assert sorted(np.concatenate([b.rows for b in found]).tolist()) == list(range(len(vectors)))
    for b in found:
        assert len(b.rows) <= 200
        assert np.linalg.norm(vectors[b.rows] - b.centre, axis=1).max() <= b.radius + 1e-12
        assert np.linalg.norm(vectors[b.rows], axis=1).max() <= b.norm + 1e-12


def test_the_corpus_is_not_moved(spark, tmp_path, monkeypatch):
    random = np.random.default_rng(5)
    corpus = random.normal(size=(3000, 8)).astype(np.float32)
    queries = random.normal(size=(70, 8)).astype(np.float32)
    frame(spark, np.arange(3000), corpus, "corpus_id").repartition(4).write.parquet(f"{tmp_path}/corpus")
    stored = spark.read.parquet(f"{tmp_path}/corpus")
    scans = []
    written = retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df, purpose: (scans.append((purpose, df._jdf.queryExecution().executedPlan().toString())), written(df, purpose))[1])
    found = top_k(frame(spark, np.arange(70), queries, "query_id"), stored, 4, broadcast_bytes=0, block_rows=20, stored=True)
    assert rows(found) == expected(np.arange(70), queries, np.arange(3000), corpus, 4)
    plans = [plan for purpose, plan in scans if purpose in ("candidates", "corpus-sample")]
    assert len(plans) == 5 and all(f"{tmp_path}/corpus" in p and "Exchange" not in p for p in plans)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"{tmp_path}/corpus" not in plan and "candidates" in plan


@pytest.mark.parametrize("k", [1, 7])
def test_null_ids_of_no_query(spark, k):
    corpus = np.eye(5, 8, dtype=np.float32)
    assert rows(top_k(frame(spark, [], [], "query_id"), frame(spark, range(5), corpus, "corpus_id"), k, broadcast_bytes=-1)) == set()
