"""From raw documents to training data, in stages that each write what they keep.

Every stage but the last returns the columns of documents; where it changes a text, ``n_chars``
follows. Rows are taken as they are, repeated ids and nulls included, as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import bpe, decontamination, lines, ngram_join, quality
from assayer.llm.common import table
from assayer.llm.queries import tokenizer_path
from assayer.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near duplicates here are word shingles of five, at a similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as long as the texts are now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps, as they are."""
    rows = quality.ledger(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    return quality.apply_policy(rows, quality.V2).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; those that have no other stay as they are.

    Copies, near ones as in the next stage, are no evidence of boilerplate: that stage keeps one of them whole.
    """
    return _counted(lines.drop_boilerplate(docs, site="source", copies=(SHINGLE, PERCENT)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id."""
    return ngram_join.keep_one(docs, n=SHINGLE, percent=PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are little else go."""
    return _counted(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (packed, 32 bits each) and the number of them."""
    encoded = bpe.encode(docs, tokenizer_path())
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]
#: The near-duplicate and encoding stages have no SQL; tests compare run() with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stages keep of ``documents``, each stage written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
