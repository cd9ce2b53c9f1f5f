"""Exact top-k retrieval, context assembly, and classification by neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.templates import render
from assayer.operators.joins import join_spread
from assayer.operators.metrics import accuracy
from assayer.operators.retrieval import fetch_text, top_k, top_k_text, with_context
from assayer.plans.rag import rag_prompts
from assayer.plans.spec import RagSpec, TaskSpec
from assayer.queries.registry import query, rounded, table
from assayer.session import materialize

_PAIRS = """scores AS (
        SELECT q.vec_id AS query_id, c.vec_id AS corpus_id, round(list_dot_product(
            CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 12) AS s
        FROM embeddings q, embeddings c {where}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, corpus_id) AS rank FROM scores),
    hits AS (SELECT query_id, corpus_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {k})"""

_TOP3 = "WITH " + _PAIRS.format(where="", k=3) + " SELECT * FROM hits"


def _vectors(spark: SparkSession, sf_dir: str, id_name: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(id_name), "embedding")


@query("rag_topk", _TOP3)
def rag_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = top_k(_vectors(spark, sf_dir, "query_id"), _vectors(spark, sf_dir, "corpus_id"), 3)
    return hits.withColumn("score", rounded("score"))


@query("rag_topk_blocked", _TOP3)
def rag_topk_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for two large sides: queries in groups, the corpus scanned where it lies, blocks in the order of bounds."""
    queries, corpus = _vectors(spark, sf_dir, "query_id"), _vectors(spark, sf_dir, "corpus_id")
    hits = top_k(queries, corpus, 3, broadcast_bytes=0, block_rows=1024, stored=True)
    return hits.withColumn("score", rounded("score"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("corpus_id"), "text")


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors that have a document."""
    return _vectors(spark, sf_dir, "corpus_id").join(_texts(spark, sf_dir).select("corpus_id"), "corpus_id")


_WITH_DOC = "JOIN documents d ON d.doc_id = c.vec_id"


@query(
    "rag_fetch",
    "WITH " + _PAIRS.format(where=_WITH_DOC, k=2)
    + " SELECT h.query_id, h.rank, h.score, h.corpus_id, d.text FROM hits h JOIN documents d ON d.doc_id = h.corpus_id",
)
def rag_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = top_k(_vectors(spark, sf_dir, "query_id"), _corpus(spark, sf_dir), 2)
    return fetch_text(hits, _texts(spark, sf_dir)).withColumn("score", rounded("score"))


@query(
    "rag_context",
    "WITH " + _PAIRS.format(where=_WITH_DOC, k=3)
    + """ SELECT h.query_id, string_agg('- [' || h.rank || '] ' || printf('%.3f', h.score) || ' ' || d.text, chr(10) ORDER BY h.rank) AS context,
        count(*) AS n FROM hits h JOIN documents d ON d.doc_id = h.corpus_id GROUP BY h.query_id""",
)
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _vectors(spark, sf_dir, "query_id")
    hits = top_k(queries, _corpus(spark, sf_dir), 3).withColumn("score", rounded("score"))
    found = with_context(
        queries.select("query_id"), fetch_text(hits, _texts(spark, sf_dir)), "- [{rank}] {score:.3f} {text}", "\n"
    )
    return found.select("query_id", "context", F.size("results").cast("long").alias("n"))


_SPARSE = """counts AS (
        SELECT side, id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n
        FROM (SELECT side, id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS token
            FROM (SELECT 'q' AS side, item_id AS id, {query} AS text FROM benchmark
                UNION ALL SELECT 'c', doc_id, text FROM documents))
        WHERE token <> '' GROUP BY ALL),
    weights AS (SELECT side, id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY side, id)) AS w FROM counts),
    scores AS (SELECT q.id AS query_id, c.id AS corpus_id, round(sum(q.w * c.w), 12) AS s
        FROM weights q JOIN weights c ON q.bucket = c.bucket WHERE q.side = 'q' AND c.side = 'c' GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, corpus_id) AS rank FROM scores),
    hits AS (SELECT query_id, corpus_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 3)"""


@query("rag_topk_sparse", "WITH " + _SPARSE.format(query="text") + " SELECT * FROM hits")
def rag_topk_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return top_k_text(queries, _texts(spark, sf_dir), 3).withColumn("score", rounded("score"))


@query(
    "rag_prompt",
    "WITH " + _SPARSE.format(query="'Find: ' || text")
    + """, contexts AS (SELECT h.query_id, string_agg('- ' || d.text, chr(10) ORDER BY h.rank) AS context,
            string_agg(CAST(h.corpus_id AS VARCHAR), ',' ORDER BY h.rank) AS hit_ids
        FROM hits h JOIN documents d ON d.doc_id = h.corpus_id GROUP BY h.query_id)
    SELECT b.item_id AS idx, 'Context:' || chr(10) || c.context || chr(10) || 'Question: ' || b.text AS prompt,
        'Find: ' || b.text AS query, c.hit_ids FROM benchmark b JOIN contexts c ON c.query_id = b.item_id""",
)
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = TaskSpec(
        name="qa",
        dataset="benchmark",
        prompt_template="Context:\n{context}\nQuestion: {question}",
        input_mappings={"question": "text"},
        rag=RagSpec(
            enabled=True,
            corpus="documents",
            corpus_template="{text}",
            corpus_mappings={"text": "text"},
            embedder="hashed",
            context_template="- {text}",
            context_separator="\n",
            query_template="Find: {question}",
        ),
    )
    examples = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.struct("*").alias("row"))
    prompts = rag_prompts(examples, _texts(spark, sf_dir), task)
    hit_ids = F.transform("extra.rag.results", lambda h: h["id"].cast("string"))
    return prompts.select("idx", "prompt", F.col("extra.rag.query").alias("query"), F.array_join(hit_ids, ",").alias("hit_ids"))


@query(
    "rag_knn_accuracy",
    "WITH " + _PAIRS.format(where=_WITH_DOC + " WHERE q.vec_id <> c.vec_id", k=3)
    + """, votes AS (SELECT h.query_id, e.label, count(*) AS n, sum(h.score) AS total
            FROM hits h JOIN embeddings e ON e.vec_id = h.corpus_id GROUP BY ALL),
    majority AS (SELECT query_id, label FROM votes
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1),
    contexts AS (SELECT h.query_id, sum(length(d.text)) + 4 AS n_chars
        FROM hits h JOIN documents d ON d.doc_id = h.corpus_id GROUP BY h.query_id)
    SELECT CAST(q.label AS VARCHAR) AS task, count(*) AS n, round(avg(CASE WHEN m.label = q.label THEN 1 ELSE 0 END), 6) AS accuracy,
        CAST(sum(c.n_chars + length('Label this: ')) AS BIGINT) AS prompt_chars
    FROM embeddings q JOIN majority m ON m.query_id = q.vec_id JOIN contexts c ON c.query_id = q.vec_id
    GROUP BY q.label""",
)
def rag_knn_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is classified by its nearest neighbours; how often is that right?

    Retrieval, late fetch of the texts, context, prompt, majority label, accuracy.
    """
    queries = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    # One hit more, because the best hit of a vector is the vector itself.
    found = top_k(queries, _corpus(spark, sf_dir), 4).where(F.col("query_id") != F.col("corpus_id"))
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    nearest = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= 3)
    # Votes and contexts both start from the hits.
    hits = materialize(nearest, "hits")
    labels = queries.select(F.col("query_id").alias("corpus_id"), F.col("label").alias("hit_label"))
    votes = join_spread(hits, labels, "corpus_id", "query_id").groupBy("query_id", "hit_label").agg(F.count("*").alias("n"))
    majority = votes.groupBy("query_id").agg(
        F.max_by("hit_label", F.struct("n", -F.col("hit_label"))).alias("prediction")
    )
    asked = queries.select(
        F.lit("neighbours").alias("model"), F.col("label").cast("string").alias("task"), "query_id", F.col("label").alias("reference")
    )
    scored = asked.join(majority, "query_id")
    prompts = with_context(asked, fetch_text(hits, _texts(spark, sf_dir), stored=True))
    prompt = render(prompts.schema, "Label this: {context}", {}, {"context": (F.col("context"), T.StringType())})
    sizes = (
        prompts.where(F.size("results") > 0)
        .groupBy("task")
        .agg(F.count("*").alias("n"), F.sum(F.length(prompt).cast("long")).alias("prompt_chars"))
    )
    return sizes.join(accuracy(scored), "task").select(
        "task", "n", rounded("metric_value").alias("accuracy"), "prompt_chars"
    )
