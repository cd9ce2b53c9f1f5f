import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.operators.chunking import fixed_chunks, recursive_chunks, register_chunker, split_text

RECURSIVE = [
    ("one two three four five six", 12, 4, [(0, "one two"), (4, "two three"), (14, "four five"), (24, "six")]),
    ("aa bb\n\ncc dd ee\nff", 8, 2, [(0, "aa bb"), (7, "cc dd"), (13, "ee"), (16, "ff")]),
    ("abcdefghij", 4, 1, [(0, "abcd"), (3, "defg"), (6, "ghij")]),
    ("", 4, 1, []),
    (" \n ", 4, 1, []),
]


@pytest.mark.parametrize("text,size,overlap,expected", RECURSIVE)
def test_recursive(text, size, overlap, expected):
    assert split_text(text, size, overlap) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \né", max_size=120), st.integers(2, 20), st.integers(0, 1))
def test_recursive_chunks_cover_the_text(text, size, overlap):
    chunks = split_text(text, size, overlap)
    covered = [False] * len(text)
    for start, chunk in chunks:
        assert text[start : start + len(chunk)] == chunk
        assert 0 < len(chunk) <= size
        covered[start : start + len(chunk)] = [True] * len(chunk)
    assert all(seen or c.isspace() for seen, c in zip(covered, text)) or overlap


def pieces(text, level):
    """Text cut before every separator of a level; by hand, one character at a time."""
    separator = ("\n\n", "\n", " ", "")[level]
    cuts, at = [0], 0
    while at < len(text):
        if separator == "" or text.startswith(separator, at):
            cuts.append(at)
            at += max(len(separator), 1)
        else:
            at += 1
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


def slow_split(text, size, overlap, level=0):
    while ("\n\n", "\n", " ", "")[level] not in text:
        level += 1
    chunks, window = [], []

    def emit(parts):
        chunk = "".join(parts).strip()
        if chunk:
            chunks.append(chunk)

    def close():
        emit(window)
        window.clear()

    for piece in pieces(text, level):
        if len(piece) >= size:
            close()
            chunks.extend(slow_split(piece, size, overlap, level + 1) if level < 3 else [piece])
            continue
        if window and len("".join(window)) + len(piece) > size:
            emit(window)
            while len("".join(window)) > overlap or (window and len("".join(window)) + len(piece) > size):
                del window[0]
        window.append(piece)
    close()
    return chunks


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n", max_size=80), st.integers(3, 15), st.integers(0, 2))
def test_recursive_against_the_slow_form(text, size, overlap):
    assert [c for _, c in split_text(text, size, overlap)] == slow_split(text, size, overlap)


def test_recursive_on_the_documents(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    found = {}
    for row in recursive_chunks(documents, "text", 200, 20).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(row.doc_id, []).append(row.chunk)
    for row in documents.collect():
        assert found.get(row.doc_id, []) == slow_split(row.text, 200, 20)


def test_recursive_rows(spark):
    df = spark.createDataFrame([(1, "one two three four five six"), (2, ""), (3, None)], "id int, text string")
    rows = recursive_chunks(df, "text", 12, 4).orderBy("id", "chunk_index").collect()
    assert [(r.id, r.chunk, r.chunk_start, r.chunk_end, r.chunk_index) for r in rows] == [
        (1, "one two", 0, 7, 0), (1, "two three", 4, 13, 1), (1, "four five", 14, 23, 2), (1, "six", 24, 27, 3),
    ]
    assert recursive_chunks(df, "text", 0).where("id = 1").first().chunk == "one two three four five six"
    with pytest.raises(ValueError):
        recursive_chunks(df, "text", 4, 4)


FIXED = [
    ("abcdefghij", 4, 1, [("abcd", 0, 4, 0), ("defg", 3, 7, 1), ("ghij", 6, 10, 2), ("j", 9, 10, 3)]),
    ("abcde", 4, 2, [("abcd", 0, 4, 0), ("cde", 2, 5, 1), ("e", 4, 5, 2)]),
    ("abc", 0, 9, [("abc", 0, 3, 0)]),
    ("", 4, 1, []),
]


@pytest.mark.parametrize("text,size,overlap,expected", FIXED)
def test_fixed(spark, text, size, overlap, expected):
    df = spark.createDataFrame([(text,)], "text string")
    rows = fixed_chunks(df, "text", size, overlap).orderBy("chunk_index").collect()
    assert [(r.chunk, r.chunk_start, r.chunk_end, r.chunk_index) for r in rows] == expected


def test_sql_table_function(spark):
    register_chunker(spark, "cut")
    spark.createDataFrame([("abcdefghij",)], "t string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT c.* FROM texts, LATERAL cut(t, 4, 1) c ORDER BY chunk_index").collect()
    assert [tuple(r) for r in rows] == [("abcd", 0, 0), ("defg", 3, 1), ("ghij", 6, 2)]
