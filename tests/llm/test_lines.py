"""Boilerplate lines on a small site, against the definition."""

import random
import time

import corpus_pipeline
from pyspark.sql import functions as F

from assayer.llm import lines

BLANK = " \t\x0b\x0c\r"


def slow(rows, ratio, least):
    out = []
    for _, site, text in rows:
        pages = [t for _, s, t in rows if s == site]
        kept = []
        for line in (text or "").split("\n"):
            bare = line.strip(BLANK)
            n = sum(bare in [x.strip(BLANK) for x in (t or "").split("\n")] for t in pages)
            if not (site is not None and bare and n >= least and n > ratio * len(pages)):
                kept.append(line)
        out.append(None if text is None else "\n".join(kept))
    return out


def test_against_the_definition(spark, monkeypatch):
    rows = [(i, "a", f"menu\nline {i}\n menu \n\nrare {i % 4}") for i in range(12)]
    rows += [(20 + i, "b", f"menu\nb {i}") for i in range(2)]
    rows += [(30 + i, None, "menu") for i in range(9)]
    rows += [(40, "a", None), (41, "a", ""), (42, "a", "menu"), (42, "a", "menu"), (43, "c", "x" * 50_000)]
    expected = sorted(zip([r[0] for r in rows], slow(rows, 0.1, 3)), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for limit in (lines.SENT_LINES, 0):
        monkeypatch.setattr(lines, "SENT_LINES", limit)
        got = lines.drop_boilerplate(docs, ratio=0.1, min_pages=3)
        assert got.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == expected


def test_counts_and_clashing_names(spark):
    docs = spark.createDataFrame([(i, "a", "x\ny", "keep") for i in range(6)], "_site long, source string, text string, _lines string")
    got = lines.drop_boilerplate(docs, dropped="gone", min_pages=2).collect()
    assert {(r["text"], r["gone"], r["_lines"]) for r in got} == {("", 2, "keep")}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert lines.drop_boilerplate(docs).collect() == []


def test_copies_are_no_evidence_of_boilerplate(spark):
    """A third of a source are copies, exact or near; one of them goes through both stages whole."""
    letters = random.Random(5)

    def prose(n):
        return [" ".join("".join(letters.choices("abcdefgh", k=6)) for _ in range(20)) for _ in range(n)]

    own = prose(12)
    copied = "\n".join(own)
    # Each near copy has other words in two lines, so that a line is whole on some and changed on others.
    strewn = ["\n".join(f"{x} z{i}" if k in (i % 12, (i + 5) % 12) else x for k, x in enumerate(own)) for i in range(30)]
    for group in ([copied] * 30, strewn, [copied] * 5):
        others = ["\n".join(["the menu", *prose(6)]) for _ in range(2 * len(group) if len(group) > 5 else 94)]
        texts = [*(f"the menu\n{t}" for t in group), *others]
        docs = spark.createDataFrame([(i, "a", t, len(t)) for i, t in enumerate(texts)], "doc_id long, source string, text string, n_chars long")
        cleaned = corpus_pipeline.line_dedup(spark, docs, "")
        assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == {i: t.removeprefix("the menu\n") for i, t in enumerate(texts)}
        kept = corpus_pipeline.near_duplicates(spark, cleaned, "")
        assert {r["doc_id"] for r in kept.collect()} == {0, *range(len(group), len(texts))}


def test_no_text_loses_every_line_where_copies_count_once(spark):
    docs = spark.createDataFrame([(i, "a", f"{a}\n \n{b}") for i, (a, b) in enumerate([("x", "y"), ("y", "x"), ("x", "z"), ("x", "u"), ("y", "v")])], "doc_id long, source string, text string")
    got = lines.drop_boilerplate(docs, min_pages=2, dropped="gone", copies=(5, 80)).orderBy("doc_id").collect()
    assert [(r["text"], r["gone"]) for r in got] == [("x\n \ny", 0), ("y\n \nx", 0), (" \nz", 1), (" \nu", 1), (" \nv", 1)]


def test_long_texts_of_distinct_lines_take_linear_time(spark):
    """A site of equal pages of 100,000 lines: every line is boilerplate, but for one of each page."""
    start = time.perf_counter()
    texts = spark.range(6, numPartitions=3).select(
        F.lit("s").alias("source"),
        F.concat_ws("\n", F.concat(F.lit("own "), F.col("id").cast("string")), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")).alias("text"),
    )
    got = lines.drop_boilerplate(texts, dropped="gone").collect()
    assert sorted((r["text"], r["gone"]) for r in got) == [(f"own {i}", 100_000) for i in range(6)]
    assert time.perf_counter() - start < 60
