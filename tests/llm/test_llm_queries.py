"""Registered queries without SQL, and the pipeline, against plain versions over the whole small tables."""

import hashlib
import json
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from assayer.llm import bpe, decontamination, quality, warc
from assayer.llm.queries import QUALITY_SQL, QUERIES, SQL, URL_RULES, tokenizer_path
from assayer.session import materialize
from plain import hits, linked, rows, without_boilerplate, without_hits
from test_substrings import slow as without_repeats


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def documents(small):
    return rows(small, "documents")


@pytest.fixture(scope="module")
def tokenizer():
    with open(tokenizer_path(), encoding="utf-8") as file:
        return bpe.load(file.read())


def test_every_operator_is_registered():
    numbers = {int(m[1]) for name in QUERIES if (m := re.match(r"op(\d+)_", name))}
    assert numbers == set(range(1, len(numbers) + 1)) and set(SQL) <= set(QUERIES)


def test_decontamination(spark, small, documents):
    items = [(r["item_id"], r["text"]) for r in rows(small, "benchmark")]
    got = {r["doc_id"]: r for r in QUERIES["op1_decontamination"](spark, small).collect()}
    assert len(got) == len(documents)
    for d in documents:
        n, hit, names = hits(d["text"], items)
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(names), bool(hit))
        assert r["items_sha256"] == sha(",".join(sorted(map(str, names))).encode())


def test_suffix_dedup(spark, small, documents):
    ordered = sorted((d["doc_id"], d["text"]) for d in documents)
    got = sorted(tuple(r) for r in QUERIES["op2_suffix_dedup"](spark, small).collect())
    expected = [
        (i, n, sum(b - a for a, b in spans), len(spans), sha(kept))
        for (i, _), (n, spans, kept) in zip(ordered, without_repeats(ordered))
    ]
    assert got == expected


def test_warc(spark, small):
    got = sorted(tuple(r) for r in QUERIES["op3_warc_derivatives"](spark, small).collect())
    pages = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    expected = [
        (r["page_id"], kind, *(made.get(h) for h in ("WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Block-Digest")),
         len(made.block), sha(warc.build(*made)))
        for r in warc.responses(pages).collect() for kind, made in warc.derive_record(bytes(r["record"]))
    ]
    assert got == sorted(expected) and len(got) == 2 * pages.count()


def test_bpe(spark, small, documents, tokenizer):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op4_bpe_roundtrip"](spark, small).collect()}
    for d in documents:
        ids = tokenizer.encode(d["text"], add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[d["doc_id"]] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded.encode()))


def test_ngram_join(spark, small, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op7_ngram_join"](spark, small).collect()}
    assert got == linked([(d["doc_id"], d["text"]) for d in documents])


def test_url_filter(spark, small):
    got = QUERIES["op8_url_filter"](spark, small).collect()
    assert len(got) == len(rows(small, "pages"))
    for r in got:
        fits = [x for x in URL_RULES if (r["host"] == x.host or r["host"].endswith("." + x.host)) and r["path"].startswith(x.path)]
        best = max(fits, key=lambda x: len(x.text), default=None)
        assert r["rule"] == (best.text if best else None)
        assert r["verdict"] == (best.verdict if best else "block" if r["score"] > 0 else "allow")


def test_shards(spark, small, documents):
    got = QUERIES["op9_hilbert_shards"](spark, small).collect()
    texts = {d["doc_id"]: d["text"].encode() for d in documents}
    import zlib

    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(by_shard) == list(range(40)) and {r["law"] for r in got} == {"rows"}
    sizes = [len(s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_pipeline(spark, small, documents, tokenizer):
    """Stage by stage: each is judged on what its predecessor kept."""
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    kept = {i for i, in database.sql(QUALITY_SQL + "SELECT doc_id FROM f WHERE failed = 0").fetchall()}
    expected = [dict(d) for d in documents if d["doc_id"] in kept]
    assert 0 < len(expected) < len(documents)
    cleaned = [{**d, "text": t} for d, t in zip(expected, without_boilerplate(expected))]
    expected = [d for d, before in zip(cleaned, expected) if d["text"] == before["text"] or re.search(r"\S", d["text"])]
    found = linked([(d["doc_id"], d["text"]) for d in expected], corpus_pipeline.SHINGLE, corpus_pipeline.PERCENT)
    expected = [d for d in expected if found[d["doc_id"]][1] == d["doc_id"]]
    items = [(r["item_id"], r["text"]) for r in rows(small, "benchmark")]
    expected = [{**d, "text": t} for d in expected if (t := without_hits(d["text"], items)) is not None]
    result = corpus_pipeline.run(spark, small)
    assert result.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"]
    got = {r["doc_id"]: r for r in result.collect()}
    assert sorted(got) == sorted(d["doc_id"] for d in expected)
    for d in expected:
        r = got[d["doc_id"]]
        ids = tokenizer.encode(d["text"], add_special_tokens=False).ids
        assert (r["text"], r["n_chars"], r["lang"], r["source"]) == (d["text"], len(d["text"]), d["lang"], d["source"])
        assert (np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["n_tokens"]) == (ids, len(ids))


def test_pipeline_stages_on_odd_tables(spark, small):
    """Nulls, repeated rows, an extra column with a name the operators use, and no rows at all."""
    long = " ".join(f"word{i}" for i in range(60))
    odd = [(1, long, "en", "a", 5, "x"), (1, long, "en", "a", 5, "x"), (None, long + " more", None, None, None, None), (2, None, "en", "a", 0, "x"), (3, "", "en", None, 0, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, found string"
    for data in (odd, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = materialize(stage(spark, docs, small), name)
            assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
        assert docs.count() == (1 if data else 0)


def test_rules_cover_the_measures():
    assert {r.bit for r in quality.RULES} == set(range(len(quality.RULES)))
    assert json.dumps([p.mask() for p in quality.POLICIES]) == "[3, 15, 127]"
    assert decontamination.WINDOW == 10
