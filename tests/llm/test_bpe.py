"""Chunked encoding against the library itself, for two tokenizers."""

import random

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import bpe
from assayer.llm.common import as_bytes

tokenizers = pytest.importorskip("public_tokenizers")
FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def source(name):
    with open(tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def texts(seed=1):
    dice = random.Random(seed)
    words = ["the", "The", "don't", "über", "é", "́x", "x y", "中文", "7", "1234", "...", "<|endoftext|>", "<|startoftext|>ab", "a" * 80, "Σ", "'s", " "]
    out = ["", " ", "\n\n", "a", " a ", "x" * 5000, "a\r\n b\t\tc", "<|endoftext|>"]
    passage = " ".join(dice.choice(words) for _ in range(300))
    for _ in range(40):
        parts = [dice.choice(words) + dice.choice([" ", "  ", "\n", "", "\t"]) for _ in range(dice.randint(1, 400))]
        out.append("".join(parts) + (passage if dice.random() < 0.5 else "") + "".join(reversed(parts)))
    return out


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("chunk_bytes", [16, 64, 2048])
def test_against_the_library(name, chunk_bytes):
    tokenizer = bpe.load(source(name))
    encoder = bpe.ChunkEncoder(tokenizer, chunk_bytes, entries=50, size=10_000)
    rows = texts()
    expected = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(rows, add_special_tokens=False)]
    for _ in range(2):
        assert encoder.encode(*as_bytes(pa.array(rows))) == expected
    ids = [np.frombuffer(e, "<u4") for e in expected]
    assert bpe.decoder(tokenizer)(ids) == [tokenizer.decode(r.tolist(), skip_special_tokens=False) for r in ids]


def test_shared_chunks_are_encoded_once():
    encoder = bpe.ChunkEncoder(bpe.load(source(FILES[0])), 256)
    passage = " ".join(f"word{i}" for i in range(3000))
    encoder.encode(*as_bytes(pa.array([passage])))
    first = encoder.n_cores
    encoder.encode(*as_bytes(pa.array([f"{i} other beginning {passage}" for i in range(20)])))
    assert first > 20 and encoder.n_cores < first + 60 and not encoder.n_whole


def test_spaces_separate_tokens_of_one_tokenizer_only():
    assert [bpe.spaces_separate(bpe.load(source(f))) for f in FILES] == [True, False]


def test_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(2))] + [(900, None, "x"), (1, " ", "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    path = tokenizers.path(FILES[0])
    encoded = bpe.encode(docs, path)
    assert encoded.columns == ["doc_id", "text", "ids"]
    tokenizer = bpe.load(source(FILES[0]))
    got = bpe.decode(encoded, path).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        assert r["decoded"] == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs.limit(0), path), path).collect() == []
