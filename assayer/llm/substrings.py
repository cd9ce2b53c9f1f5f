"""Removal of long byte strings that occur earlier in the corpus, by sorting suffixes.

A string of ``length`` bytes is repeated when an equal one starts earlier (smaller document, or
the same document, earlier byte). Sorting every suffix of a corpus would move each byte many
times, so only the suffixes at *anchors* are sorted: every window of ``length`` bytes has one
anchor, the place with the least hash among its runs of 32 bytes, and equal windows have their
anchors at the same place within them. Neighbouring windows share an anchor, so a text has about
one anchor for 35 windows.

1. Each task turns its texts into anchors with their windows and keeps the first of those that
   are equal in full; the others are repeats already.
2. Shuffled by the anchor's hash, and in order, all but the first of equal ones are repeats. An
   anchor whose surroundings differ from place to place goes on, one without company is done.
3. The suffixes at those anchors are sorted: by eight-byte digits down to a shallow depth, then
   the groups that still agree by blind tries. The common prefixes of neighbours in this order,
   and those of the bytes before the anchor, tell for every window which are equal.

An anchor in more surroundings than ``crowd`` (a line that is everywhere) is not sorted in one
task: each of its windows goes to a place of its own, by the hash of the whole window.

Nulls count as empty texts. Texts shorter than ``length`` lose nothing. Repeated rows and equal
ids count as documents of their own, in the order of :func:`assayer.llm.common.with_row_key`;
an empty table gives an empty table. Strings are judged on the input, never on what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Spans, as_bytes, mix, random_table, steps, with_row_key
from assayer.session import materialize

LENGTH = 100
#: Bytes that an anchor's hash looks at (a power of two).
GRAM = 32
#: Distinct surroundings of an anchor that one task sorts together.
CROWD = 512
#: Anchors that a task compares among themselves before it passes them on.
LOCAL = 1_000_000
#: Bytes beyond the anchor that are sorted by digits; tries take over from there.
SHALLOW = GRAM + 16

_PLACE_BITS = 22  # of a position within one step; longer texts are taken in pieces
_PIECE = 1 << _PLACE_BITS
_GRAMS, _FIRST, _SECOND = random_table(21), random_table(22), random_table(23)

# A position is packed with the number of its windows and the anchor's distance: in order of position.
_REPEAT, _SORT, _SINGLE, _ANCHOR = 0, 1, 2, 3
_ROWS = "kind byte, g long, h long, key long, place long"
_SCHEMA = pa.schema([("kind", pa.int8()), ("g", pa.int64()), ("h", pa.int64()), ("key", pa.int64()), ("place", pa.int64())])
Batches = Iterator[pa.RecordBatch]


def _packed(start: np.ndarray, windows: np.ndarray, distance: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 16) | (windows.astype(np.int64) << 8) | distance.astype(np.int64)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 16, (place >> 8) & 255, place & 255


def _rows(kind: int, g: np.ndarray, h: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(key), kind, np.int8), g.astype(np.int64), h.astype(np.int64), key, place]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SCHEMA)


def _repeats(key: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    """Stretches of repeated windows, neighbours merged, dealt by document."""
    order = np.lexsort((start, key))
    key, start, windows = key[order], start[order], windows[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + windows[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(windows, first) if len(first) else windows
    return _rows(_REPEAT, mix(key[first]), total, key[first], start[first])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For every anchor: first window, number of windows, distance from the first window, hash."""
    size = len(data)
    if size < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    grams = _GRAMS[data]
    reach = 1
    while reach < GRAM:
        grams = grams[:-reach] * np.uint64(pow(0xD1342543DE82EF95, reach, 1 << 64)) + grams[reach:]
        reach *= 2
    grams = mix(grams)
    low = np.uint64(_PIECE * 2 - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    width, reach = length - GRAM + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: reach - width], least[width - reach :])
    anchor = (least & low).astype(np.int64)
    whole = np.zeros(len(anchor) + 1, np.int8)
    fits = offsets[1:] - offsets[:-1] >= length
    np.add.at(whole, offsets[:-1][fits], 1)
    np.add.at(whole, offsets[1:][fits] - length + 1, -1)
    whole = np.cumsum(whole[:-1]).astype(bool)
    new = whole.copy()
    new[1:] &= ~whole[:-1] | (anchor[1:] != anchor[:-1])
    start = np.flatnonzero(new)
    closing = np.ones(len(anchor), bool)
    closing[:-1] = new[1:] | ~whole[1:]
    end = np.flatnonzero(whole & closing)
    return start, end - start + 1, anchor[start] - start, grams[anchor[start]]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """(first row, start byte, row bounds from there, bytes of the row before it); long rows overlap."""
    for first, last in steps(offsets):
        a, b = int(offsets[first]), int(offsets[last])
        if b - a <= _PIECE:
            yield first, a, offsets[first : last + 1] - a, 0
            continue
        at = a
        while at + length <= b:
            stop = min(at + _PIECE, b)
            yield first, at, np.array([0, stop - at]), at - a
            at = stop - length + 1


def _find_anchors(length: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for row, at, bounds, before in _pieces(offsets, length):
                part = data[at : at + int(bounds[-1])]
                start, windows, distance, gram = anchors(part, bounds, length)
                if not len(start):
                    continue
                inner = np.searchsorted(bounds, start, "right") - 1
                whole = Spans(part, _FIRST)(start, start + windows + (length - 1))
                whole = mix(whole ^ mix(windows.astype(np.uint64) << np.uint64(8) | distance.astype(np.uint64)))
                place = _packed(start - bounds[inner] + before, windows, distance)
                held.append((gram.view(np.int64), whole.view(np.int64), keys[row + inner], place))
                count += len(start)
                if count >= LOCAL:
                    yield from _first_of_equals(held)
                    held, count = [], 0
        if held:
            yield from _first_of_equals(held)

    return run


def _first_of_equals(held: list[tuple[np.ndarray, ...]], kind: int = _ANCHOR) -> Batches:
    g, h, key, place = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((place, key, h, g))
    g, h, key, place = g[order], h[order], key[order], place[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
    start, windows, _ = _unpacked(place[~new])
    if len(start):
        yield _repeats(key[~new], start, windows)
    yield _rows(kind, g[new], h[new], key[new], place[new])


def _settle(crowd: int) -> Callable[[Batches], Batches]:
    """Anchors in order of (g, h, key, place): repeats, and those to be sorted."""

    def run(batches: Batches) -> Batches:
        held = [np.zeros(0, np.int64)] * 4  # the first of each kind of surroundings of the last anchor
        seen = (0, 0)  # the last row's anchor and surroundings
        crowded = None  # an anchor known to be in too many
        some = False
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            if (kinds == _REPEAT).any():
                yield batch.filter(pa.array(kinds == _REPEAT))
            columns = [batch.column(n).to_numpy(zero_copy_only=False)[kinds != _REPEAT] for n in ("g", "h", "key", "place")]
            g, h, key, place = columns
            if not len(g):
                continue
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
            new[0] = not some or (g[0], h[0]) != seen
            some, seen = True, (g[-1], h[-1])
            start, windows, _ = _unpacked(place[~new])
            if len(start):
                yield _repeats(key[~new], start, windows)
            g, h, key, place = (np.concatenate([x, y[new]]) for x, y in zip(held, columns))
            if crowded is not None:
                cut = np.searchsorted(g, crowded, "right")
                if cut:
                    yield _rows(_SINGLE, g[:cut], h[:cut], key[:cut], place[:cut])
                    g, h, key, place = g[cut:], h[cut:], key[cut:], place[cut:]
                if len(g):
                    crowded = None
            if not len(g):
                held = [g, h, key, place]
                continue
            last = int(np.searchsorted(g, g[-1]))
            if len(g) - last > crowd:
                crowded = g[-1]
                last = len(g)
            yield from _onward(g[:last], h[:last], key[:last], place[:last], crowd)
            held = [g[last:], h[last:], key[last:], place[last:]]
        if len(held[0]):
            yield from _onward(*held, crowd)

    return run


def _onward(g: np.ndarray, h: np.ndarray, key: np.ndarray, place: np.ndarray, crowd: int) -> Batches:
    _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
    company = count[inverse]
    for kind, chosen in ((_SORT, (company > 1) & (company <= crowd)), (_SINGLE, company > crowd)):
        if chosen.any():
            yield _rows(kind, g[chosen], h[chosen], key[chosen], place[chosen])


_SUFFIX_ROWS = f"{_ROWS}, bytes binary"
_SUFFIXES = pa.schema([*_SCHEMA, ("bytes", pa.binary())])


def _with_bytes(batch: pa.RecordBatch, column: pa.Array | None = None) -> pa.RecordBatch:
    column = pa.nulls(len(batch), pa.binary()) if column is None else column
    return pa.RecordBatch.from_arrays([*batch.columns, column], schema=_SUFFIXES)


def _fetch(length: int) -> Callable[[Batches], Batches]:
    """The bytes of the anchors to be sorted; the windows of crowded ones, one by one, as hashes."""

    def run(batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            wanted = batch.column("wanted").combine_chunks() if isinstance(batch.column("wanted"), pa.ChunkedArray) else batch.column("wanted")
            bounds = wanted.offsets.to_numpy()
            fields = wanted.values
            kind, g, place = (fields.field(n).to_numpy(zero_copy_only=False) for n in ("kind", "g", "place"))
            for first, last in steps(offsets):
                rows = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))
                these = slice(int(bounds[first]), int(bounds[last]))
                start, windows, distance = _unpacked(place[these])
                start = start + offsets[rows]
                sort = kind[these] == _SORT
                if sort.any():
                    raw = data[int(offsets[first]) : int(offsets[last])].tobytes()
                    base = int(offsets[first])
                    parts = [raw[a - base : b - base] for a, b in zip(start[sort].tolist(), (start + windows + (length - 1))[sort].tolist())]
                    found = _rows(_SORT, g[these][sort], np.zeros(sort.sum(), np.int64), keys[rows[sort]], place[these][sort])
                    yield _with_bytes(found, pa.array(parts, pa.binary()))
                single = ~sort
                if single.any():
                    base = int(offsets[first])
                    part = data[base : int(offsets[last])]
                    n = windows[single]
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at = np.repeat(start[single], n) + within
                    one, two = (Spans(part, t)(at - base, at - base + length).view(np.int64) for t in (_FIRST, _SECOND))
                    row = np.repeat(rows[single], n)
                    ones = np.ones(len(at), np.int64)
                    held.append((one, two, keys[row], _packed(at - offsets[row], ones, 0 * ones)))
                    count += len(at)
                    if count >= LOCAL:
                        yield from map(_with_bytes, _first_of_equals(held, _SINGLE))
                        held, count = [], 0
        if held:
            yield from map(_with_bytes, _first_of_equals(held, _SINGLE))

    return run


class _Node:
    __slots__ = ("children", "depth", "members")

    def __init__(self, depth: int, members: list[int] | None = None) -> None:
        self.depth, self.members, self.children = depth, members, {}


def blind_sort(strings: list[bytes], members: list[int], depth: int) -> tuple[list[int], list[int]]:
    """The members in the order of their strings, and what each has in common with the one before.

    ``depth`` bytes are known to agree. The trie keeps only where strings part: a new string
    goes down by those bytes alone, is compared with the one string it meets, and the place of
    the first difference tells where it belongs. A shorter string comes before its extensions.
    """
    root = _Node(-1)  # above the first branching, so that every node has a parent
    root.children[0] = _Node(len(strings[members[0]]), [members[0]])
    for member in members[1:]:
        text = strings[member]
        node, path = root.children[0], [(root, 0)]
        while node.members is None:
            byte = text[node.depth] if node.depth < len(text) else -1
            if byte not in node.children:
                byte = next(iter(node.children))
            path.append((node, byte))
            node = node.children[byte]
        other = strings[node.members[0]]
        if other == text:
            node.members.append(member)
            continue
        agree = _common(text, other, depth)
        while path[-1][0].depth > agree:
            path.pop()
        parent, byte = path[-1]
        if parent.depth < agree:
            below = parent.children[byte]
            middle = _Node(agree)
            middle.children[other[agree] if agree < len(other) else -1] = below
            parent.children[byte] = middle
            parent = middle
        parent.children[text[agree] if agree < len(text) else -1] = _Node(len(text), [member])
    order: list[int] = []
    common: list[int] = []
    stack = [(root.children[0], depth)]
    while stack:
        node, before = stack.pop()
        if node.members is not None:
            order += node.members
            common += [before] + [node.depth] * (len(node.members) - 1)
            continue
        inner = sorted(node.children, reverse=True)
        stack += [(node.children[b], node.depth) for b in inner[:-1]]
        stack.append((node.children[inner[-1]], before))
    return order, common


def _common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are sure."""
    low, high = known, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def deep_shallow(strings: list[bytes], group: np.ndarray, known: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings within their groups, and the bytes each shares with its predecessor.

    ``known`` bytes agree within a group. Down to ``shallow`` the strings are sorted by digits of
    eight bytes; where those agree as well, a blind trie sorts the rest. The first of a group
    shares nothing (-1).
    """
    n = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    digits = -(-(shallow - known) // 8)
    padded = b"".join(s[known : known + 8 * digits].ljust(8 * digits, b"\0") for s in strings)
    shorter = np.minimum(lengths, known + 8 * digits)
    words = np.frombuffer(padded, ">u8").reshape(n, digits).astype(np.uint64)
    order = np.lexsort((shorter, *(words[:, i] for i in range(digits - 1, -1, -1)), group))
    same = np.zeros(n, bool)  # as the one before, down to the shallow depth
    same[1:] = (group[order][1:] == group[order][:-1]) & (words[order][1:] == words[order][:-1]).all(1) & (shorter[order][1:] == shorter[order][:-1])
    common = np.full(n, -1, np.int64)
    edges = np.flatnonzero(~same)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), n]):
        if a and group[order[a]] == group[order[a - 1]]:
            common[a] = _common(strings[order[a]], strings[order[a - 1]], known)
        if b - a > 1:
            members, shared = blind_sort(strings, order[a:b].tolist(), min(known + 8 * digits, int(shorter[order[a]])))
            order[a:b] = members
            common[a + 1 : b] = shared[1:]
            if a and common[a] >= 0:  # the trie may have put another string first; the common part is the same
                common[a] = _common(strings[order[a]], strings[order[a - 1]], known)
    return order, common


def equal_windows(
    group: np.ndarray, texts: list[bytes], windows: np.ndarray, distance: np.ndarray, length: int
) -> np.ndarray:
    """Which windows of which row equal one of an earlier row of the group (rows x length)."""
    n = len(texts)
    right, after = deep_shallow([t[d:] for t, d in zip(texts, distance.tolist())], group, GRAM, SHALLOW)
    left, before = deep_shallow([t[:d][::-1] for t, d in zip(texts, distance.tolist())], group, 0, SHALLOW - GRAM)
    repeated = np.zeros((n, length), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for reach in range(int(distance.max()) + 1):  # bytes of the window before the anchor
        inside = np.flatnonzero((distance >= reach) & (distance - reach < windows))
        if len(inside) < 2:
            continue
        right_class[right] = np.cumsum(after < length - reach)
        left_class[left] = np.cumsum(before < reach)
        pair = right_class[inside] * (n + 1) + left_class[inside]
        first = np.zeros(len(inside), bool)
        first[np.unique(pair, return_index=True)[1]] = True
        again = inside[~first]
        repeated[again, distance[again] - reach] = True
    return repeated


def _sort_suffixes(length: int) -> Callable[[Batches], Batches]:
    """Rows in order of (kind, g, h, key, place): the repeats among them."""

    def sorted_groups(held: list[pa.RecordBatch]) -> Batches:
        rows = pa.Table.from_batches(held)
        g, key, place = (rows.column(n).to_numpy() for n in ("g", "key", "place"))
        start, windows, distance = _unpacked(place)
        again = equal_windows(g, rows.column("bytes").to_pylist(), windows, distance, length)
        row, at = np.nonzero(again)
        if len(row):
            yield _repeats(key[row], start[row] + at, np.ones(len(row), np.int64))

    def run(batches: Batches) -> Batches:
        seen, some = (0, 0), False
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            if (kinds == _REPEAT).any():
                yield batch.filter(pa.array(kinds == _REPEAT)).select(_SCHEMA.names)
            single = np.flatnonzero(kinds == _SINGLE)
            if len(single):
                g, h, key, place = (batch.column(n).to_numpy(zero_copy_only=False)[single] for n in ("g", "h", "key", "place"))
                new = np.ones(len(g), bool)
                new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1])
                new[0] = not some or (g[0], h[0]) != seen
                some, seen = True, (g[-1], h[-1])
                if not new.all():
                    start, windows, _ = _unpacked(place[~new])
                    yield _repeats(key[~new], start, windows)
            if (kinds == _SORT).any():
                rows = batch.filter(pa.array(kinds == _SORT))
                g = rows.column("g").to_numpy(zero_copy_only=False)
                last = int(np.searchsorted(g, g[-1]))  # the last group may go on in the next batch
                if last or (held and held[-1].column("g")[-1].as_py() != g[0]):
                    held.append(rows.slice(0, last))
                    count += last
                    if count >= 4096:
                        yield from sorted_groups(held)
                        held, count = [], 0
                held.append(rows.slice(last))
                count += len(g) - last
        if held:
            yield from sorted_groups(held)

    return run


def repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """(key, start, windows): stretches of window starts whose windows occur earlier.

    ``docs`` has a distinct ``key`` in the order of the documents, and ``text``.
    """
    if not GRAM < length < GRAM + 256:
        raise ValueError(f"length must be between {GRAM + 1} and {GRAM + 255}")
    found = docs.select("key", "text").mapInArrow(_find_anchors(length), _ROWS)
    settled = (
        found.repartition("g").sortWithinPartitions("g", "h", "key", "place").mapInArrow(_settle(crowd), _ROWS)
    )
    settled = materialize(settled, "anchors")
    wanted = (
        settled.where(F.col("kind") != _REPEAT)
        .groupBy("key")
        .agg(F.collect_list(F.struct("kind", "g", "place")).alias("wanted"))
    )
    suffixes = docs.select("key", "text").join(wanted, "key").mapInArrow(_fetch(length), _SUFFIX_ROWS)
    again = (
        suffixes.repartition("g")
        .sortWithinPartitions("kind", "g", "h", "key", "place")
        .mapInArrow(_sort_suffixes(length), _ROWS)
    )
    both = settled.where(F.col("kind") == _REPEAT).unionByName(again.where(F.col("kind") == _REPEAT))
    return both.select("key", F.col("place").alias("start"), F.col("h").alias("windows"))


def _cut(length: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            ids, found = batch.column("doc_id"), batch.column("found")
            for first, last in steps(offsets):
                rows = []
                for i in range(first, last):
                    text = data[offsets[i] : offsets[i + 1]]
                    size, spans = len(text), []
                    stretches = found[i].as_py() or []
                    for a, b in sorted((s["start"], s["start"] + s["windows"] + length - 1) for s in stretches):
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(b, spans[-1][1])
                        else:
                            spans.append([a, b])
                    raw, edges = text.tobytes(), [0, *(x for s in spans for x in s), size]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    rows.append((size, [{"start": a, "end": b} for a, b in spans], kept))
                sizes, spans, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, last - first), pa.array(sizes, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "spans", "kept"],
                )

    return run


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, crowd: int = CROWD
) -> DataFrame:
    """One row per document: doc_id, n_bytes, the removed ``spans`` (byte ranges), the ``kept`` bytes."""
    keyed = with_row_key(docs, doc_id, text)
    found = repeats(keyed, length, crowd).groupBy("key").agg(F.collect_list(F.struct("start", "windows")).alias("found"))
    joined = keyed.join(found, "key", "left").select("doc_id", "text", "found")
    return joined.mapInArrow(
        _cut(length), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )
