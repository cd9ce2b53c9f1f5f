import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.operators import retrieval
from assayer.operators.embedding import embed_with
from assayer.operators.joins import join_spread
from assayer.operators.retrieval import fetch_text, top_k, top_k_text, with_context


def frame(spark, ids, vectors, name):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def expected(query_ids, queries, corpus_ids, corpus, k):
    found = set()
    for q, vector in zip(query_ids, queries):
        scores = np.round(corpus.astype(np.float64) @ vector.astype(np.float64), 12)
        order = sorted(range(len(corpus)), key=lambda i: (-scores[i], corpus_ids[i]))[:k]
        found |= {(int(q), int(corpus_ids[i]), rank) for rank, i in enumerate(order, 1)}
    return found


def rows(df):
    return {(r.query_id, r.corpus_id, r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    random = np.random.default_rng(3)
    queries = random.normal(size=(40, 8)).astype(np.float32)
    corpus = random.normal(size=(300, 8)).astype(np.float32)
    # A third of the corpus is one vector.
    corpus[::3] = corpus[0]
    return np.arange(40) * 2, queries, random.permutation(300) * 7, corpus


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 10, "block_rows": 16}, {"broadcast_bytes": 0, "block_rows": 1000}])
@pytest.mark.parametrize("k", [1, 5, 150, 1000])
def test_top_k_against_brute_force(spark, data, options, k):
    query_ids, queries, corpus_ids, corpus = data
    left = frame(spark, query_ids, queries, "query_id")
    right = frame(spark, corpus_ids, corpus, "corpus_id").repartition(5)
    assert rows(top_k(left, right, k, **options)) == expected(query_ids, queries, corpus_ids, corpus, k)


def test_large_scores_rank_exactly(spark, data):
    query_ids, queries, corpus_ids, corpus = data
    queries, corpus = queries * 1000, corpus * 1000
    found = top_k(frame(spark, query_ids, queries, "query_id"), frame(spark, corpus_ids, corpus, "corpus_id"), 3)
    assert rows(found) == expected(query_ids, queries, corpus_ids, corpus, 3)


def test_edges(spark, data):
    query_ids, queries, corpus_ids, corpus = data
    left, right = frame(spark, query_ids, queries, "query_id"), frame(spark, corpus_ids, corpus, "corpus_id")
    assert top_k(left.limit(0), right, 3).count() == 0
    with pytest.raises(ValueError, match="empty"):
        top_k(left, right.limit(0), 3)
    with pytest.raises(ValueError):
        top_k(left, right, 0)


def test_text_retrieval_and_context(spark):
    corpus = spark.createDataFrame(
        [(0, "red apples and pears"), (1, "blue sky"), (2, "blue sky")], "corpus_id long, text string"
    )
    queries = spark.createDataFrame([(7, "Blue SKY!"), (8, "  "), (9, "apples")], "query_id long, text string")
    hits = fetch_text(top_k_text(queries, corpus, 2), corpus)
    found = {r.query_id: r for r in with_context(queries, hits, "{rank}:{text}", " | ").collect()}
    assert found[7].context == "1:blue sky | 2:blue sky"
    assert [h.id for h in found[7].results] == [1, 2]
    assert found[8].context == "" and found[8].results == []
    assert found[9].context.startswith("1:red apples and pears | 2:")


def test_each_text_is_encoded_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def load():
        def encode(texts):
            seen.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return encode

    def side(n, name):
        texts = spark.range(n, numPartitions=3).select(F.col("id").alias(name), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
        return embed_with(texts, "text", load, 16)

    for limit in (1 << 20, 0):
        before = seen.value
        assert top_k(side(100, "query_id"), side(40, "corpus_id"), 2, checked=True, broadcast_bytes=limit).count() == 200
        assert seen.value - before == 140


def test_wrong_vectors_are_named(spark):
    good = [(i, [1.0, float(i)]) for i in range(5)]
    for bad in (None, [1.0]):
        rows = [spark.createDataFrame(good + extra, f"{key} long, embedding array<double>") for key, extra in (("query_id", []), ("corpus_id", [(77, bad)]))]
        with pytest.raises(Exception, match="corpus_id 77"):
            top_k(*rows, 1).collect()
        rows = [spark.createDataFrame(good + extra, f"{key} long, embedding array<double>") for key, extra in (("query_id", [(78, bad)]), ("corpus_id", []))]
        with pytest.raises(Exception, match="query_id 78"):
            top_k(*rows, 1).collect()


def test_texts_without_a_hit_stay_where_they_are(spark, monkeypatch, tmp_path):
    texts = spark.range(1000).select(F.col("id").alias("corpus_id"), F.col("id").cast("string").alias("text"))
    texts.write.parquet(f"{tmp_path}/corpus")
    corpus = spark.read.parquet(f"{tmp_path}/corpus")
    hits = spark.range(300).select(F.col("id").alias("query_id"), F.when(F.col("id") < 200, 7).otherwise(F.col("id")).cast("long").alias("corpus_id"))
    expected = [(i, 7 if i < 200 else i, str(7 if i < 200 else i)) for i in range(300)]

    def fetched():
        found = fetch_text(hits, corpus)
        return found, sorted((r.query_id, r.corpus_id, r.text) for r in found.collect())

    found, rows = fetched()
    assert rows == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("text#", plan.index("FileScan parquet [corpus_id"))]
    assert "BroadcastHashJoin" in above
    initial = plan.split("Initial Plan")[-1]
    scan = next(i for i, line in enumerate(initial.splitlines()) if "FileScan parquet [corpus_id" in line and "text" in line)
    below = initial.splitlines()[:scan]
    depth = [len(line) - len(line.lstrip(" :+-")) for line in below]
    joined = max(i for i, line in enumerate(below) if "LeftSemi" in line)
    assert not any("Exchange hashpartitioning" in line and depth[i] > depth[joined] for i, line in enumerate(below[joined:], joined))
    # More ids than may be sent; one document with most hits, split into parts.
    monkeypatch.setattr(retrieval, "ID_BYTES", 8)
    assert fetched()[1] == expected
    spread = join_spread(hits, corpus, "corpus_id", "query_id", hot_rows=1)
    assert sorted((r.query_id, r.corpus_id, r.text) for r in spread.collect()) == expected
