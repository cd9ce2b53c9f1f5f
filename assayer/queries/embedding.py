"""Embeddings: pooling, normalisation, plug-in encoders, hashed token counts."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.vectors import as_doubles, l2_normalize
from assayer.operators.embedding import embed_hashed, embed_with, first_token_pool, mean_pool
from assayer.queries.registry import query, rounded, table


def _dimensions(df: DataFrame, key: str) -> DataFrame:
    exploded = df.select(key, F.posexplode("embedding").alias("dim", "value"))
    return exploded.select(key, F.col("dim").cast("long"), rounded("value").alias("value"))


_NORMALIZED = """norms AS (SELECT {key}, sqrt(sum(value * value)) AS norm FROM pooled GROUP BY {key})
    SELECT {key}, dim, round(value / norm, 6) AS value FROM pooled JOIN norms USING ({key})"""


@query(
    "embed_mean_pool",
    """WITH tokens AS (SELECT CAST(label AS BIGINT) AS label, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS mask,
            unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings),
    pooled AS (SELECT label, dim, sum(x * mask) / greatest(sum(mask), 1e-9) AS value FROM tokens GROUP BY ALL),
    """ + _NORMALIZED.format(key="label"),
)
def embed_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("long"))
    return _dimensions(mean_pool(tokens, "label", "embedding", F.col("vec_id") % 3 != 0), "label")


@query(
    "embed_cls_pool",
    """WITH firsts AS (SELECT CAST(label AS BIGINT) AS label, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS v FROM embeddings GROUP BY ALL),
    pooled AS (SELECT label, unnest(range(0, len(v))) AS dim, unnest(v) AS value FROM firsts),
    """ + _NORMALIZED.format(key="label"),
)
def embed_cls_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("long"))
    return _dimensions(first_token_pool(tokens, "label", "vec_id", "embedding"), "label")


@query(
    "l2_normalize",
    """WITH pooled AS (SELECT vec_id, unnest(range(0, len(embedding))) AS dim,
            unnest(CAST(embedding AS DOUBLE[])) * (label - 4) AS value FROM embeddings),
    norms AS (SELECT vec_id, greatest(sqrt(sum(value * value)), 1e-12) AS norm FROM pooled GROUP BY vec_id)
    SELECT vec_id, dim, round(value / norm, 6) + 0 AS value FROM pooled JOIN norms USING (vec_id)""",
)
def l2_normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretched vectors, some of them to zero."""
    vectors = table(spark, sf_dir, "embeddings")
    stretched = F.transform(as_doubles(F.col("embedding")), lambda x: x * (F.col("label") - 4))
    vectors = vectors.select("vec_id", stretched.alias("stretched"))
    unit = vectors.select("vec_id", l2_normalize(F.col("stretched")).alias("embedding"))
    return _dimensions(unit, "vec_id").withColumn("value", F.col("value") + 0.0)


@query(
    "embed_hashed",
    """WITH pooled AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT % 256 AS dim, count(*) AS value
        FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS token FROM documents)
        WHERE token <> '' GROUP BY ALL),
    """ + _NORMALIZED.format(key="doc_id"),
)
def embed_hashed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = embed_hashed(table(spark, sf_dir, "documents"), "doc_id", "text")
    return _dimensions(embedded, "doc_id").where(F.col("value") != 0)


def digest_encoder():
    """A deterministic stand-in for a neural encoder: sixteen values from a text's digest."""

    def encode(texts: list[str]) -> np.ndarray:
        digests = [hashlib.md5(t.encode()).digest() for t in texts]
        return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(len(texts), 16)

    return encode


@query(
    "embed_plugin",
    """WITH pooled AS (SELECT doc_id, unnest(range(0, 16)) AS dim,
            unnest(list_transform(range(0, 16), lambda i: ('0x' || substr(md5(text), 2 * i + 1, 2))::BIGINT)) AS value FROM documents),
    """ + _NORMALIZED.format(key="doc_id"),
)
def embed_plugin(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _dimensions(embed_with(documents, "text", digest_encoder), "doc_id")
