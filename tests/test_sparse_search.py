"""Search through postings: the same hits as by scoring everything, with blocks left out."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.operators.embedding import embed_hashed
from assayer.operators.retrieval import top_k, top_k_text
from assayer.operators.sparse_search import Postings, Sparse, SparseSearch, searching, to_batch, unit_counts


def sparse(random, n, n_terms, most, first=0):
    rows = np.repeat(np.arange(n), random.integers(0, most, n))
    return unit_counts(np.arange(first, first + n), rows, random.integers(0, n_terms, len(rows)), n_terms)


def dense(rows, n_terms):
    out = np.zeros((len(rows.ids), n_terms))
    out[np.repeat(np.arange(len(rows.ids)), np.diff(rows.offsets)), rows.terms] = rows.weights
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 12), st.integers(1, 150), st.integers(1, 40), st.integers(1, 6), st.integers(1, 9), st.integers(0, 9999))
def test_hits_are_those_of_scoring_everything(n, m, n_terms, k, block, seed):
    random = np.random.default_rng(seed)
    queries, corpus = sparse(random, n, n_terms, 6), sparse(random, m, n_terms, 9, 1000)
    search = SparseSearch(queries, k, block)
    for part in np.array_split(np.arange(len(corpus.ids)), 3):
        if len(part):
            a, b = corpus.offsets[part[0]], corpus.offsets[part[-1] + 1]
            search.add(Sparse(corpus.ids[part], corpus.offsets[part[0] : part[-1] + 2] - a, corpus.terms[a:b], corpus.weights[a:b]))
    scores = np.round(dense(queries, n_terms) @ dense(corpus, n_terms).T, 12)
    expected = [
        (int(queries.ids[q]), int(corpus.ids[i])) for q in range(len(queries.ids))
        for i in sorted(range(len(corpus.ids)), key=lambda i: (-scores[q, i], corpus.ids[i]))[:k]
    ]
    found = search.hits()
    assert list(zip(found["query_id"].to_pylist(), found["corpus_id"].to_pylist())) == expected


def test_blocks_are_left_out_and_hot_terms_are_split():
    """One term is in all rows; the rare ones decide."""
    random = np.random.default_rng(3)
    n, n_terms = 6000, 50_000
    rows = np.repeat(np.arange(n), 12)
    terms = random.integers(1, n_terms, len(rows))
    terms[::12] = 0
    corpus = unit_counts(np.arange(n), rows, terms, n_terms)
    asked = np.concatenate([np.repeat(np.arange(40), 4), np.arange(40)])
    wanted = np.concatenate([np.concatenate([corpus.terms[corpus.offsets[i * 100] + 1 :][:4] for i in range(40)]), np.zeros(40, np.int64)])
    search = SparseSearch(unit_counts(np.arange(40), asked, wanted, n_terms), 1)
    search.add(corpus)
    assert [int(x[0]) for x in search.best_ids] == [i * 100 for i in range(40)]
    assert search.scored < 0.1 * search.possible
    postings = Postings(corpus, np.array([0]))
    assert len(postings.rows) == n and postings.max_starts.tolist() == [0, postings.n_blocks]


@pytest.mark.parametrize("limit", [1 << 20, 400])
def test_texts(spark, limit):
    random = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    def texts(n, first):
        return [(first + i, " ".join(random.choice(words, random.integers(0, 9)))) for i in range(n)] + [(first + n, None), (first + n + 1, "...")]
    queries = spark.createDataFrame(texts(20, 0), "query_id long, text string")
    corpus = spark.createDataFrame(texts(300, 500), "corpus_id long, text string").repartition(4)
    found = {tuple(r) for r in top_k_text(queries, corpus, 4, dim=64, broadcast_bytes=limit).collect()}
    sides = embed_hashed(queries, "query_id", "text", 64), embed_hashed(corpus, "corpus_id", "text", 64)
    assert {(q, c, r) for q, c, _, r in found} == {(q, c, r) for q, c, _, r in map(tuple, top_k(*sides, 4, checked=True).collect())}
    assert len(found) % 4 == 0 and found


def test_postings_are_made_of_a_number_of_terms(monkeypatch):
    """Rows of many terms are searched in smaller chunks, with the same hits."""
    random = np.random.default_rng(8)
    queries, corpus = sparse(random, 5, 5000, 9), sparse(random, 9000, 5000, 200, 1000)
    sizes = []
    added = SparseSearch.add
    monkeypatch.setattr(SparseSearch, "add", lambda self, rows: (sizes.append(len(rows.terms)), added(self, rows))[1])
    batch = to_batch(corpus, ("corpus_id", "terms", "weights"))
    found = pa.Table.from_batches(searching(lambda: queries, 3)(iter([batch])))
    assert sum(sizes) == len(corpus.terms) and max(sizes) < 2 * (1 << 18)
    whole = SparseSearch(queries, 3)
    added(whole, corpus)
    assert found.to_pydict() == whole.hits().to_pydict()


def test_texts_and_search_share_a_python_worker(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "b c")], "corpus_id long, text string")
    found = top_k_text(texts.withColumnRenamed("corpus_id", "query_id"), texts, 1)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
