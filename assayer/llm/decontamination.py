"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words go into one automaton for each block of items; a document's words stream
through it while the state keeps the longest stretch of words that ends here and occurs in an
item. Where that stretch reaches the window length (ten words; an item with fewer is a window
as a whole) the last words of it are hit. :func:`find` reports the hits, :func:`decontaminate`
cuts them out and drops documents that are mostly benchmark text.

Words are runs of letters, digits and other non-ASCII characters, A-Z lower-cased. Null and
empty texts have no words and no hits; an item without words, or of which the id is null, has
no windows or, respectively, hits words without being named. Repeated documents and repeated
items are judged one by one; no items means no hits. Equal item ids count once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.common import fresh

WINDOW = 10
#: Item words in one automaton, which every Python worker holds; more items take more passes.
BLOCK_WORDS = 100_000

_SPLITTER = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("first", "end", "start_char", "end_char")])
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
])
_SPAN_TYPE = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "end", "start_char", "end_char")]))
_FOUND_TYPE = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", _SPAN_TYPE), ("item_ids", pa.list_(pa.string())),
])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPLITTER).split()


class SuffixAutomaton:
    """All stretches of words of the items, with the items that each window occurs in."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            state = 0
            for word in words:
                state = self._extend(state, word)
        # By state, the suffix of its stretches that is a whole window; links lead to shorter stretches.
        self.whole = [0] * len(self.link)
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        for state in by_length:
            link = self.link[state]
            self.whole[state] = self.whole[link] if self.length[link] >= window else state
        self.windows: dict[int, set[str | None]] = {}  # by the state of a whole window
        self.shorts: dict[int, dict[int, set[str | None]]] = {}  # by state: short items, by their length
        for name, words in items:
            self._mark(name, words)
        # By state, itself or its longest suffix that is a short item; 0 if there is none.
        self.short = [0] * len(self.link)
        for state in by_length if self.shorts else ():
            self.short[state] = state if state in self.shorts else self.short[self.link[state]]

    def _state(self, length: int, go: dict[bytes, int], link: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, word: bytes) -> int:
        known = self.go[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.go[at]:
            self.go[at][word] = new
            at = self.link[at]
        if at >= 0:
            other = self.go[at][word]
            fits = self.length[other] == self.length[at] + 1
            self.link[new] = other if fits else self._clone(at, word, other)
        return new

    def _clone(self, at: int, word: bytes, state: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.go[state]), self.link[state])
        self.link[state] = copy
        while at >= 0 and self.go[at].get(word) == state:
            self.go[at][word] = copy
            at = self.link[at]
        return copy

    def _mark(self, name: str | None, words: list[bytes]) -> None:
        if len(words) < self.window:
            state = 0
            for word in words:
                state = self.go[state][word]
            self.shorts.setdefault(state, {}).setdefault(len(words), set()).add(name)
            return
        for _, state, length in self._walk(words):
            if length >= self.window:
                self.windows.setdefault(self.whole[state], set()).add(name)

    def _walk(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """For every word that ends a known stretch: position, state, length of the longest."""
        go, link, lengths, root = self.go, self.link, self.length, self.go[0]
        state = length = 0
        for i, word in enumerate(words):
            step = go[state].get(word)
            if step is not None:
                length += 1
            else:
                if word not in root:
                    state = length = 0
                    continue
                while step is None:
                    state = link[state]
                    step = go[state].get(word)
                length = lengths[state] + 1
            state = step
            yield i, state, length

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged ranges of hit words, and the names of the items with a window in ``words``."""
        if self.shorts:
            return self._match_all(words)
        go, link, lengths, root, window = self.go, self.link, self.length, self.go[0], self.window
        hits: list[tuple[int, int]] = []
        seen: set[int] = set()
        state = length = 0
        # As in _walk, written out: this loop sees every word of the corpus.
        for i, word in enumerate(words):
            step = go[state].get(word)
            if step is not None:
                length += 1
                state = step
                if length >= window:
                    seen.add(self.whole[state])
                    _add(hits, i + 1 - window, i + 1)
            elif word not in root:
                state = length = 0
            else:
                while step is None:
                    state = link[state]
                    step = go[state].get(word)
                length = lengths[state] + 1
                state = step
                if length >= window:
                    seen.add(self.whole[state])
                    _add(hits, i + 1 - window, i + 1)
        return hits, self._names(seen)

    def _names(self, windows: set[int]) -> set[str | None]:
        return set().union(*(self.windows[w] for w in windows))

    def _match_all(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        found: list[tuple[int, int]] = []
        seen: set[int] = set()
        short: set[tuple[int, int]] = set()
        for i, state, length in self._walk(words):
            start = i + 1
            if length >= self.window:
                seen.add(self.whole[state])
                start = i + 1 - self.window
            state = self.short[state]
            while state:  # suffixes of the stretch that are short items, at most one for each length
                for size in self.shorts[state]:
                    if size <= length:
                        short.add((state, size))
                        start = min(start, i + 1 - size)
                state = self.short[self.link[state]]
            if start <= i:
                found.append((start, i + 1))
        names = self._names(seen).union(*(self.shorts[state][size] for state, size in short))
        return merged(found), names


def _add(hits: list[tuple[int, int]], start: int, end: int) -> None:
    if hits and start <= hits[-1][1]:
        hits[-1] = (min(start, hits[-1][0]), end)
    else:
        hits.append((start, end))


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _located(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Word ranges with the characters they cover."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(a, b, places[a][0], places[b - 1][1]) for a, b in ranges]


def _pass(block: Broadcast, text: str, found: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(block.value, window)
        for batch in batches:
            texts = batch.column(text)
            earlier = batch.column(found) if found in batch.schema.names else None
            rows = []
            for i in range(len(texts)):
                value = texts[i].as_py()
                words = words_of(value)
                ranges, names = automaton.match(words)
                if earlier is not None and (before := earlier[i].as_py())["n_hit"]:
                    ranges = merged(ranges + [(s["first"], s["end"]) for s in before["spans"]])
                    names |= set(before["item_ids"])
                spans = _located(value, ranges) if ranges else []
                rows.append({
                    "n_words": len(words),
                    "n_hit": sum(b - a for a, b in ranges),
                    "spans": [dict(zip(SPAN.names, s)) for s in spans],
                    "item_ids": sorted(x for x in names if x is not None),
                })
            column = pa.array(rows, _FOUND_TYPE)
            names = [n for n in batch.schema.names if n != found]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, found])

    return run


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items' words, in blocks of about ``block_words``, one at a time on the driver.

    The blocks are dealt by hash and sized by the items' bytes (a word has two at least, with
    what separates it), so a block holds a bounded share however many items there are.
    """
    slim = items.select(F.col(item_id).cast("string").alias("name"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (2 * block_words)))
    block = F.pmod(F.xxhash64("name", "text"), F.lit(n))
    for i in range(n):
        yield [(name, words_of(body)) for name, body in slim.where(block == i).collect()]


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    found: str = "found",
) -> DataFrame:
    """``docs`` with a struct ``found`` of type :data:`FOUND` (a column of that name is replaced).

    The documents are read once, in place, without a shuffle: each block of items is one more
    step on the same row, which adds to what the blocks before it have found.
    """
    docs = docs.drop(found)
    schema = T.StructType([*docs.schema.fields, T.StructField(found, FOUND)])
    context = docs.sparkSession.sparkContext
    for block in item_blocks(items, item_id, item_text, block_words):
        docs = docs.mapInArrow(_pass(context.broadcast(block), text, found, window), schema)
    return docs


def _without_spans(text: Column, spans: Column) -> Column:
    """The characters of ``text`` outside ``spans``."""
    n = F.size(spans)
    kept = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.substring(
            text,
            F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end_char"]) + 1,
            F.when(i < n, F.get(spans, i)["start_char"]).otherwise(F.char_length(text))
            - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end_char"]),
        ),
    )
    return F.when(n == 0, text).otherwise(F.array_join(kept, ""))


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    window: int = WINDOW,
    min_span: int = 1,
    max_coverage: float = 0.8,
    **options: object,
) -> DataFrame:
    """``docs`` without hit spans of ``min_span`` words or more, and without documents whose hit
    words are more than ``max_coverage`` of all their words.

    The columns stay as they are but for ``text``: every removed span goes from the first
    character of its first word to the last of its last.
    """
    found = fresh("found", docs.columns)
    rows = find(docs, items, text, window=window, found=found, **options)
    long = F.filter(F.col(found)["spans"], lambda s: s["end"] - s["first"] >= min_span)
    hit = F.aggregate(long, F.lit(0), lambda n, s: n + s["end"] - s["first"])
    rows = rows.where(hit <= F.col(found)["n_words"] * F.lit(max_coverage))
    return rows.withColumn(text, F.when(F.size(long) > 0, _without_spans(F.col(text), long)).otherwise(F.col(text))).drop(found)
