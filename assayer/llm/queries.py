"""The registered queries of the training-data operators, each next to its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import (
    bpe, conversation_trie, decontamination, extraction, lines, mixing, ngram_join, quality, sharding, substrings, urls, vector_codes, warc,
)
from assayer.llm.common import table
from assayer.session import broadcast_if_small

# The registered query uses a public tokenizer where it is installed; the operator takes any path.
TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (
  SELECT row_number() OVER () AS r, *,
         [words[i:i + 7] FOR i IN range(1, len(words) - 6)] AS grams FROM w),
p AS (SELECT r, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM q, range(8) s(k) WHERE n > 1 GROUP BY r),
m AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals
  FROM g LEFT JOIN c USING (r)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_lines >= 5 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 2 * n_exclaims > n_words THEN 16 ELSE 0 END) + (CASE WHEN 2 * n_capitals > word_chars THEN 32 ELSE 0 END)
    + (CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) THEN 64 ELSE 0 END) AS failed
  FROM m)
"""


@query("op6_quality_ledger", QUALITY_SQL + """
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed::BIGINT AS failed,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f""")
def quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = quality.apply_policy(quality.apply_policy(rows, quality.BASE, "passed_base"), quality.V2)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed",
        (~F.col("passed_base")).alias("base_failed"), "kept",
    )


@query("quality_ablations", QUALITY_SQL + """
SELECT 'v2' AS policy, rule, count(*)::BIGINT AS rows, sum((failed & bit <> 0)::INT)::BIGINT AS failing,
       sum((failed = bit)::INT)::BIGINT AS only_this, bit_or(failed)::BIGINT AS bits_seen
FROM f, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbols', 4), ('repeated_lines', 8),
  ('exclamations', 16), ('capitals', 32), ('word_length', 64)) r(rule, bit) GROUP BY rule""")
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.ablations(rows, quality.V2)


DECONTAMINATION_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 10 THEN [w] ELSE [w[i:i + 9] FOR i IN range(1, len(w) - 8)] END) AS gram
  FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(gram) AS size FROM win),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (
  SELECT r, size, unnest([w[i:i + size - 1] FOR i IN range(1, len(w) - size + 2)]) AS gram,
    unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
h AS (SELECT r, i, size, item_id FROM g JOIN win USING (gram)),
n AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM h, range(10) s(k) WHERE k < size GROUP BY r),
m AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM h WHERE item_id IS NOT NULL GROUP BY r)
"""


@query("op1_decontamination", DECONTAMINATION_SQL + """
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)""")
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    found = F.col("found")
    return rows.select(
        "doc_id", found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"),
        F.size(found["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(found["item_ids"], ","), 256).alias("items_sha256"),
        (found["n_hit"] > 0).alias("contaminated"),
    )


@query("op4_bpe_roundtrip")
def bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, path).select("doc_id", "ids")
    return bpe.decode(encoded, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_suffix_dedup")
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op7_ngram_join")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = ngram_join.near_duplicates(docs)
    named = rows.select(F.col("key").alias("component"), F.col("doc_id").alias("component_id"))
    return rows.join(named, "component", "left").select(
        "doc_id", F.col("n_grams").alias("n_shingles"), "component_id"
    )


LINES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, *, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT r, source, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM e),
c AS (
  SELECT source, bare, count(DISTINCT r) AS pages FROM k WHERE bare <> '' AND source IS NOT NULL GROUP BY ALL),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT source, bare FROM c JOIN t USING (source) WHERE pages >= 5 AND pages > total * 0.05),
n AS (
  SELECT r, count(*) AS n_dropped, array_to_string(list(line ORDER BY i) FILTER (b.bare IS NULL), chr(10)) AS kept,
         sum((b.bare IS NOT NULL)::INT) AS gone
  FROM k LEFT JOIN b ON b.source = k.source AND b.bare = k.bare GROUP BY r)
"""


@query("op5_line_dedup", LINES_SQL + """
SELECT doc_id, source, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_dropped,
       sha256(CASE WHEN gone > 0 THEN coalesce(kept, '') ELSE text END) AS kept_sha256
FROM d LEFT JOIN n USING (r)""")
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "text",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
    )
    return lines.drop_boilerplate(docs, dropped="n_dropped").select(
        "doc_id", "source", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


@query("op9_hilbert_shards")
def hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
    )
    rows = sharding.shard(docs, ["source", "lang", "n_chars", "doc_id"], ["doc_id", "text_crc32"], 40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op10_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


URL_RULES = (
    urls.Rule.parse("org/", "allow"), urls.Rule.parse("example.org/es/", "block"), urls.Rule.parse("example.org/en/1", "block"),
    urls.Rule.parse("com/fr/", "allow"), urls.Rule.parse("com/de/", "block"),
)


@query("op8_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = F.col("judged")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select(
        "page_id", *(judged[n].alias(n) for n in ("host", "path", "rule", "verdict", "score", "words"))
    )


@query("op3_warc_derivatives")
def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.responses(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    derived = F.col("derived")
    return warc.derive(records).select(
        "page_id", *(derived[n].alias(n) for n in ("type", "record_id", "refers_to", "target_uri", "block_digest")),
        F.octet_length(derived["block"]).cast("long").alias("n_bytes"), F.sha2(derived["record"], 256).alias("record_sha256"),
    )


@query("op11_vector_codes")
def compressed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows, coded, books = vector_codes.encode(vectors)
    rows = rows.select("vec_id", "label", F.lower(F.hex(f"{coded}.code")).alias("code"), F.col(f"{coded}.error").alias("error"))
    return vector_codes.with_total(rows, "label", "error", "label_error").select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256")
    )


@query("op12_conversation_trie")
def shared_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.marked_turns(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_nodes(*conversation_trie.with_lent_heads(turns))


@query("op13_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One letter for each word, so that no list of words is made.
    letters = F.regexp_replace(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")
    words = F.coalesce(F.char_length(letters), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words.alias("size"))
    rows, mixed, targets = mixing.mix(docs, F.array("source"), F.col("size"), ["doc_id"])
    targets = targets.withColumnRenamed("source", "named")
    return rows.join(broadcast_if_small(targets), F.col("source").eqNullSafe(F.col("named")), "left").select(
        "doc_id", "size", "source_size", "target", F.col(f"{mixed}.taken").alias("taken")
    )
