"""Byte-pair encoding that reuses the encodings of content-defined chunks, and decoding.

A text is cut where a rolling hash of its last bytes hits a pattern, so passages that documents
share are cut alike wherever they stand. A task encodes each chunk once for all the documents
it holds (in tables of bounded size). A chunk's encoding is kept without its first and last
words, which the cut may have broken; each join of two chunks is encoded anew, together with
the whole words on either side, and is taken only if those words come out as they did inside
their chunks. Where they don't, the document is encoded as a whole, so the result is the
tokenizer's own in every case. Where white space always separates tokens (see
:func:`spaces_separate`), the inside of a new chunk is put together from its words, each of
which is encoded once as well.

Null and empty texts have no tokens and decode to the empty string. Rows are encoded one by one;
repeated rows get equal rows, an empty table gives an empty table. Texts without white space
make one long join and are encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from assayer.llm.common import as_bytes, mix, random_table, steps

#: Average bytes of a chunk, and the bytes of the window that is hashed (a power of two).
CHUNK_BYTES = 2048
_ROLL = 16
#: Entries and text bytes in a table of encodings before it becomes the older of two.
KEPT_ENTRIES = 200_000
KEPT_BYTES = 16 << 20

_TABLE = random_table(4)
_SPACE = b" \t\n\r\x0b\x0c"
_LEAD = re.compile(rb"[^ \t\n\r\x0b\x0c]*")
_FIRST = re.compile(rb"[ \t\n\r\x0b\x0c]+[^ \t\n\r\x0b\x0c]+")


def cut_points(data: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """Positions where a chunk ends: decided by the 16 bytes before, and never inside a character."""
    rolling = _TABLE[data]
    reach = 1
    while reach < _ROLL:
        shifted = np.zeros_like(rolling)
        shifted[reach:] = rolling[:-reach]
        rolling = rolling + shifted * np.uint64(pow(0x9E3779B97F4A7C55, reach, 1 << 64))
        reach *= 2
    ends = np.flatnonzero(mix(rolling) < np.uint64((1 << 64) // chunk_bytes)) + 1
    ends = ends[ends < len(data)]
    return ends[(data[ends] & 0xC0) != 0x80]


def spaces_separate(tokenizer: Tokenizer) -> bool:
    """Whether no token reaches over ASCII white space and none depends on what is beyond it.

    True for tokenizers whose splitting step throws white space away and whose normaliser only
    composes characters, unifies white space and changes case; each side of a space, a tab and
    a line end is compared with the two sides on their own, for letters of several scripts,
    digits, marks, apostrophes and other characters.
    """
    spec = json.loads(tokenizer.to_str())
    normaliser = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    parts = normaliser["normalizers"] if normaliser["type"] == "Sequence" else [normaliser]
    if any(p["type"] not in ("NFC", "NFD", "Replace", "Lowercase") for p in parts) or any(
        p["type"] == "Replace" and p["pattern"] != {"Regex": r"\s+"} for p in parts
    ):
        return False
    if any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", ())):
        return False
    sides = ["a", "Z", "word's", "'", "'s", "7", "12", "é", "e\u0301", "\u0301", "Σ", "я", "中文", "!", "...", "<|", "-a", "_", "\u00a0x"]

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    alone = {side: ids(side) for side in sides}
    return all(
        ids(x + space + y) == alone[x] + alone[y] for x in sides for y in sides for space in (" ", "\t", "\n", "\r\n  ", "\x0b", "\x0c")
    )


class Chunk:
    """A chunk's parts: the broken words at its ends, and what lies between them."""

    __slots__ = ("core", "first", "head", "last", "tail")

    def __init__(self, text: bytes) -> None:
        lead = _LEAD.match(text).end()
        trail = max(text.rfind(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
        self.head, self.core, self.tail = text[:lead], b"", b""
        if trail >= lead:
            core = text[lead:trail].rstrip(_SPACE)
            self.core, self.tail = core, text[lead + len(core) :]
        first = _FIRST.match(self.core)
        if first is None:  # no whole word of its own
            self.head, self.core, self.tail = text, b"", b""
        else:
            last = max(self.core.rfind(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
            self.first, self.last = first[0], self.core[last:]


class Kept:
    """Encodings by text, in two tables of bounded size; a full one replaces the older."""

    def __init__(self, entries: int, size: int) -> None:
        self.entries, self.size = entries, size
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self._bytes = 0

    def fill(self, texts: Iterable[bytes], encode: Callable[[list[bytes]], list[bytes]]) -> dict[bytes, bytes]:
        """The encodings of ``texts``, made where they are missing."""
        wanted = dict.fromkeys(texts)
        missing = []
        for text in wanted:
            ids = self.new.get(text)
            if ids is None:
                ids = self.old.get(text)
                if ids is None:
                    missing.append(text)
                    continue
                self.new[text] = ids
            wanted[text] = ids
        for text, ids in zip(missing, encode(missing)):
            wanted[text] = self.new[text] = ids
            self._bytes += len(text) + len(ids)
        if len(self.new) > self.entries or self._bytes > self.size:
            self.old, self.new, self._bytes = self.new, {}, 0
        return wanted


class ChunkEncoder:
    """Encodes documents by their chunks. Ids are bytes: little-endian, 32 bits each."""

    def __init__(
        self, tokenizer: Tokenizer, chunk_bytes: int = CHUNK_BYTES, entries: int = KEPT_ENTRIES, size: int = KEPT_BYTES
    ) -> None:
        self.tokenizer, self.chunk_bytes = tokenizer, chunk_bytes
        self.by_word = spaces_separate(tokenizer)
        self._words, self._cores, self._joins = (Kept(entries, size) for _ in range(3))
        self.n_cores = self.n_whole = 0  # chunks encoded; documents encoded as a whole

    def _direct(self, texts: list[bytes]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _inside(self, cores: list[bytes]) -> list[bytes]:
        self.n_cores += len(cores)
        if not self.by_word:
            return self._direct(cores)
        split = [core.split() for core in cores]
        known = self._words.fill((w for words in split for w in words), self._direct)
        return [b"".join([known[w] for w in words]) for words in split]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The token ids of each row of a byte column."""
        raw = data.tobytes()
        cuts = cut_points(data, self.chunk_bytes)
        chunks: dict[bytes, Chunk] = {}
        plans = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            inner = cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, b)].tolist()
            plan, pending, before = [], b"", None
            for x, y in zip([a, *inner], [*inner, b]):
                piece = raw[x:y]
                chunk = chunks.get(piece)
                if chunk is None:
                    chunk = chunks[piece] = Chunk(piece)
                pending += chunk.head
                if chunk.core:
                    plan.append((before, pending, chunk))
                    before, pending = chunk, chunk.tail
            plan.append((before, pending, None))
            plans.append(plan)
        whole = [c for c in chunks.values() if c.core]
        cores = self._cores.fill((c.core for c in whole), self._inside)
        edges = self._words.fill((w.lstrip(_SPACE) if self.by_word else w for c in whole for w in (c.first, c.last)), self._direct)
        joins = self._joins.fill((_join(*step) for plan in plans for step in plan), self._direct)
        known = {w: edges[w.lstrip(_SPACE) if self.by_word else w] for c in whole for w in (c.first, c.last)}
        out = []
        for plan, a, b in zip(plans, offsets[:-1], offsets[1:]):
            ids = _assemble(plan, cores, known, joins)
            if ids is None:
                self.n_whole += 1
                ids = self._direct([raw[a:b]])[0]
            out.append(ids)
        return out


def _assemble(plan, cores: dict[bytes, bytes], known: dict[bytes, bytes], joins: dict[bytes, bytes]) -> bytes | None:
    """The ids of a document; None where a join does not agree with the chunks beside it."""
    parts = []
    for before, pending, after in plan:
        ids = joins[_join(before, pending, after)]
        left = known[before.last] if before else b""
        right = known[after.first] if after else b""
        if len(left) + len(right) > len(ids) or not ids.startswith(left) or not ids.endswith(right):
            return None
        parts.append(ids[len(left) : len(ids) - len(right)])
        if after:
            parts.append(cores[after.core])
    return b"".join(parts)


def _join(before: Chunk | None, pending: bytes, after: Chunk | None) -> bytes:
    """The text between two chunks' cores, with the nearest whole word of each."""
    return (before.last if before else b"") + pending + (after.first if after else b"")


def load(source: str) -> Tokenizer:
    """A tokenizer from its JSON text, without truncation or padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(source)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer



def _encoding(source: Broadcast, text: str, ids: str, chunk_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(load(source.value), chunk_bytes)
        for batch in batches:
            data, offsets = as_bytes(batch.column(text))
            names = [n for n in batch.schema.names if n != ids]
            for first, last in steps(offsets):
                a, b = offsets[first], offsets[last]
                encoded = encoder.encode(data[a:b], offsets[first : last + 1] - a)
                rows = batch.slice(first, last - first)
                column = pa.array(encoded, pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), column], names=[*names, ids])

    return run


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs`` with ``ids``: the text's token ids, as little-endian unsigned 32-bit integers.

    ``tokenizer`` is the path of a tokenizer file on the driver; its text goes to the workers.
    A column named ``ids`` is replaced.
    """
    with open(tokenizer, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())])
    return docs.mapInArrow(_encoding(source, text, ids, chunk_bytes), schema)


def decoder(tokenizer: Tokenizer) -> Callable[[list[np.ndarray]], list[str]]:
    """From id arrays to texts; without a decoding step these are the tokens, joined by spaces."""
    if tokenizer.decoder is not None:
        return lambda rows: tokenizer.decode_batch([r.tolist() for r in rows], skip_special_tokens=False)
    size = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
    tokens = np.array([tokenizer.id_to_token(i) for i in range(size)], object)

    def joined(ids: np.ndarray) -> str:
        return " ".join(t for t in tokens[ids[ids < size]].tolist() if t is not None)

    return lambda rows: [joined(r) for r in rows]


def _decoding(source: Broadcast, ids: str, text: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = decoder(load(source.value))
        for batch in batches:
            data, offsets = as_bytes(batch.column(ids))
            names = [n for n in batch.schema.names if n != text]
            for first, last in steps(offsets):
                tokens = [
                    np.frombuffer(data[a:b].tobytes(), "<u4")
                    for a, b in zip(offsets[first:last], offsets[first + 1 : last + 1])
                ]
                rows = batch.slice(first, last - first)
                column = pa.array(decoded(tokens), pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), column], names=[*names, text])

    return run


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with ``text``, the ids decoded, special tokens included; a column of that name is replaced."""
    with open(tokenizer, encoding="utf-8") as file:
        source = rows.sparkSession.sparkContext.broadcast(file.read())
    rows = rows.drop(text)
    schema = T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())])
    return rows.mapInArrow(_decoding(source, ids, text), schema)
