"""Near-duplicate documents by the Jaccard similarity of their word n-grams, joined in prefix trees.

A document is the set of its distinct n-grams, in the global order of their hashes. The trees
that store the sets would not fit into one task, so documents first meet in blocks that no
link leaves:

1. Two linked sets differ in few n-grams. Dealt by hash into more parts than that, at least one
   part agrees in full; dealt into a third as many, one agrees but for two n-grams, and so do
   four of its six pieces (:class:`Parts`). Each document sends the hashes of its parts; equal
   ones tie documents together, and the components of these ties are the blocks. Documents with the same
   set are one from here on. Below a similarity of :data:`WHOLE_PARTS`, where parts are small,
   only documents go on that share so many of their first n-grams as a link needs
   (:func:`_sharing`).
2. In a block the sets are stored in a tree that shares their common beginnings
   (:class:`PrefixTree`). The sets then go down the tree, many at a time, each with its overlap
   so far, and leave every branch where even the n-grams that remain on both sides could not
   make a link, and every branch that is in their component already. What is left is compared
   in full.

A block of more than ``crowd`` n-grams never enters one task: see :func:`_thin_out`.

No similarity is estimated, and no partner or candidate is dropped. Null and empty texts have
no n-grams and are linked with nothing; a text of fewer than n words is one n-gram. Repeated
rows have equal sets and are linked (unless empty). Rows with null or equal ids count as
documents of their own. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import LOWER, NOT_SPACE, Spans, as_bytes, components, mix, random_table, row_keyed, steps, with_row_key, word_bounds
from assayer.session import broadcast_if_small, materialize

N = 3
#: Documents link when the intersection is at least this many hundredths of the union.
PERCENT = 90
#: From this similarity on parts are compared whole, and all documents send them.
WHOLE_PARTS = 87
#: Sets up to this size are too small for parts in pieces; choices of their first n-grams take their place.
SMALL = 64
#: N-grams (8 bytes each) of the distinct sets that meet in one task.
CROWD = 2_000_000
#: Sets of a large block that all others are compared with in one round.
PIVOTS = 16
#: Hashes of parts that a task compares among themselves before it passes them on.
LOCAL = 500_000
#: Rows that a task passes on in one Arrow batch.
SENT = 1 << 16

_LETTERS = random_table(71)
_MIX_WORD = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX_SIZE = np.uint64(0x165667B19E3779F9)
Batches = Iterator[pa.RecordBatch]


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each row: the hashes of its distinct n-grams, in order."""
    data = LOWER[data]
    starts, ends, bounds = word_bounds(data, offsets, NOT_SPACE)
    words = Spans(data, _LETTERS)(starts, ends)
    grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for i in range(n):
        grams = grams * _MIX_WORD + words[i : i + len(grams)]
    grams = mix(grams)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64) * _MIX_SIZE
            for i in range(a, b):
                whole = whole * _MIX_WORD + words[i : i + 1]
            out.append(mix(whole))
        else:
            out.append(grams[:0])
    return out


@lru_cache(1 << 16)
def _size_class(size: int, percent: int) -> int:
    """Sizes in steps so wide that a link spans one step at most."""
    least, at = 1, 0
    while True:
        following = least * 100 // percent + 1
        if size < following:
            return at
        least, at = following, at + 1


@lru_cache(1 << 12)
def _beyond(step: int, percent: int) -> int:
    """The least size above a class."""
    least = 1
    for _ in range(step + 1):
        least = least * 100 // percent + 1
    return least


@lru_cache(256)
def _choices(n: int, k: int) -> np.ndarray:
    """All ways to choose k of n places, as rows."""
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)


class Parts:
    """How sets of the size classes ``step`` and the next are dealt into parts.

    Of two linked sets with n <= m n-grams, the n-grams in only one are at most
    (n + m) (100 - percent) / (100 + percent), and m is at most 100 n / percent. The smaller is in
    the lower class, so this bounds how many n-grams differ. Whole parts: each differing n-gram
    spoils one. Parts of six pieces: three spoil one, and a part with two agrees in four pieces.
    """

    def __init__(self, step: int, percent: int) -> None:
        self.percent = percent
        least, small = _beyond(step - 1, percent) if step else 1, _beyond(step, percent) - 1
        differing = (small + small * 100 // percent) * (100 - percent) // (100 + percent)
        self.pieces = percent < WHOLE_PARTS and differing > 0
        # So many of the first n-grams are taken together where parts would be too small.
        self.together = min(3 if small <= SMALL else 2 if small <= 4 * SMALL else 1, -(-percent * least // 100))
        self.small = self.pieces and small <= SMALL
        self.n = (differing // 3 if self.pieces else differing) + 1
        # Parts that hold too little could agree by chance; so many of them are allowed for.
        self.spare = min(max(4 if self.pieces else 8, self.n // 6), differing)
        self.n += self.spare
        self.solid = 2 if self.pieces else 3

    def hashes(self, spread: np.ndarray, name: np.uint64) -> np.ndarray:
        """What a set sends. With no more weak parts than spare ones, a solid one agrees with any linked set."""
        if self.small:
            return self._first(spread, name)
        n = self.n
        part = ((spread >> np.uint64(11)) % np.uint64(n)).astype(np.int64)
        if self.pieces:
            part = 6 * part + (spread % np.uint64(6)).astype(np.int64)
            n *= 6
        count = np.bincount(part, minlength=n)
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(count)
        total = np.zeros(len(spread) + 1, np.uint64)
        np.cumsum(spread[order], out=total[1:])
        sums = total[ends] - total[ends - count]
        if not self.pieces:
            solid = count >= self.solid
            out = mix(sums ^ mix(np.arange(n, dtype=np.uint64) + name))
            return out[solid] if n - solid.sum() <= self.spare else out
        four = _choices(6, 4)
        sums = sums.reshape(-1, 6)[:, four].sum(2, dtype=np.uint64)
        solid = count.reshape(-1, 6)[:, four].sum(2) >= self.solid
        out = mix(sums.ravel() ^ mix(np.arange(sums.size, dtype=np.uint64) + name))[solid.ravel()]
        if (~solid.all(1)).sum() <= self.spare:
            return out
        # Two sets of which all parts that agree are weak share what both send now.
        return np.concatenate([out, self._first(spread, name + np.uint64(1 << 31))])

    def _first(self, spread: np.ndarray, name: np.uint64) -> np.ndarray:
        """Choices of the first n-grams: a linked set lacks few, so some choice is in both beginnings."""
        size, k = len(spread), self.together
        missing = size - -(-self.percent * size // 100)
        first = np.sort(spread)[: missing + k]
        out = np.zeros(1, np.uint64)
        if len(first) >= k:
            chosen = first[_choices(len(first), k)]
            out = np.zeros(len(chosen), np.uint64)
            for i in range(k):
                out = out * _MIX_WORD + chosen[:, i]
        return mix(out ^ mix(np.array([name], np.uint64)))


@lru_cache(1 << 12)
def _dealing(step: int, percent: int) -> Parts:
    return Parts(step, percent)


def _spread(grams: np.ndarray, seed: int) -> np.ndarray:
    return mix(grams + np.uint64((seed * 2 + 1) * int(_MIX_SIZE) % (1 << 64)))


def _part_hashes(grams: np.ndarray, percent: int, seed: int) -> np.ndarray:
    """The hashes of a set's parts, as one of its own size class and as the larger of a pair."""
    own = _size_class(len(grams), percent)
    spread = _spread(grams, seed)
    return np.concatenate([
        _dealing(step, percent).hashes(spread, np.uint64((seed << 50) + (step << 32)))
        for step in sorted({own, max(own - 1, 0)})
    ])


#: Share of its n-grams that a set sends beyond those that a linked set may lack.
_MORE = 20


def _first_grams(grams: np.ndarray, percent: int) -> np.ndarray:
    """The beginning of a set in the common order of all n-grams.

    A linked set lacks at most a = size - percent / 100 * size of them, so of the n-grams that
    the two share, the first l are among the first a + l of either.
    """
    size = len(grams)
    missing = size - -(-percent * size // 100)
    return np.sort(_spread(grams, 99))[: missing + -(-_MORE * size // 100)]


_PAIR = pa.schema([("kind", pa.int8()), ("block", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_PAIR_ROWS = "kind byte, block long, a long, b long"


def _pairs(kind: int, block: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a), kind, np.int8)), pa.array(block), pa.array(a), pa.array(b)], schema=_PAIR
    )


def _sent(rows: pa.RecordBatch) -> Batches:
    for at in range(0, len(rows), SENT):
        yield rows.slice(at, SENT)


def _tie(block: np.ndarray, part: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In order of (block, part, key): which are the first of their part; edges of the others to them."""
    new = np.ones(len(part), bool)
    new[1:] = (part[1:] != part[:-1]) | (block[1:] != block[:-1])
    first = key[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(key) else key
    a, b = key[~new], first[~new]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    other = np.ones(len(a), bool)
    other[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return new, a[other], b[other]


def _signatures(n: int, percent: int, seed: int) -> Callable[[Batches], Batches]:
    """Rows (0, block, part hash, key), one for each part and task, and (1, 0, key, key) for ties."""

    def tied(held: list[tuple[np.ndarray, ...]]) -> Batches:
        block, part, key = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((key, part, block))
        block, part, key = block[order], part[order], key[order]
        new, a, b = _tie(block, part, key)
        yield from _sent(_pairs(0, block[new], part[new], key[new]))
        yield from _sent(_pairs(1, np.zeros(len(a), np.int64), a, b))

    def run(batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            for first, last in steps(offsets):
                a, b = offsets[first], offsets[last]
                for i, grams in enumerate(ngram_sets(data[a:b], offsets[first : last + 1] - a, n), first):
                    if len(grams):
                        parts = _part_hashes(grams, percent, seed).view(np.int64)
                        held.append((np.full(len(parts), blocks[i]), parts, np.full(len(parts), keys[i])))
                        count += len(parts)
                    if count >= LOCAL:
                        yield from tied(held)
                        count = 0
        if held:
            yield from tied(held)

    return run


def _meet(batches: Batches) -> Batches:
    """Rows in order of (kind, block, a, b): edges from each document to the first with an equal part."""
    last = None
    for batch in batches:
        kind, block, a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if (kind == 1).any():
            yield batch.filter(pa.array(kind == 1))
        chosen = kind == 0
        block, part, key = block[chosen], a[chosen], b[chosen]
        if not len(key):
            continue
        if last is not None:
            block, part, key = (np.concatenate([[x], y]) for x, y in zip(last, (block, part, key)))
        new, a, b = _tie(block, part, key)
        at = int(np.flatnonzero(new)[-1])
        last = (block[at], part[at], key[at])
        if len(a):
            yield _pairs(1, np.zeros(len(a), np.int64), a, b)


def _blocks(docs: DataFrame, n: int, percent: int, seed: int) -> DataFrame:
    """(key, block) of the documents (key, block, text) that share a part with another of their block."""
    parts = docs.mapInArrow(_signatures(n, percent, seed), _PAIR_ROWS)
    met = parts.repartition("a").sortWithinPartitions("kind", "block", "a", "b").mapInArrow(_meet, _PAIR_ROWS)
    stars = components(met.where("kind = 1").select("a", "b"))
    centres = stars.select(F.col("b").alias("key"), F.col("b").alias("block")).distinct()
    return materialize(stars.select(F.col("a").alias("key"), F.col("b").alias("block")).unionByName(centres), "blocks")


def _needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The intersection that two sets with ``sizes`` n-grams together must have."""
    return -(-percent * sizes // (100 + percent))


class _Branch:
    __slots__ = ("children", "first", "grams", "largest", "least", "members", "sole")

    def __init__(self, grams: np.ndarray, first: int) -> None:
        self.grams, self.first = grams, first  # the first member below
        self.children: dict[int, _Branch] = {}
        self.members: list[int] = []
        self.least, self.largest = 1 << 60, 0  # sizes of the sets below
        self.sole = -1  # their component, if they are in one


class PrefixTree:
    """Ordered sets, common beginnings stored once, and the components of their links."""

    #: Bytes of the table that says which set of a batch has which n-gram.
    TABLE_BYTES = 32 << 20

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent = percent
        known, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.n_grams = len(known)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.ids = ids.astype(np.int64)
        self.ordered = np.repeat(np.arange(len(sets)), self.sizes) * self.n_grams + self.ids
        self.parent = list(range(len(sets)))
        self.visited = 0  # sets times branches
        self.root = _Branch(self.ids[:0], 0)
        for i in range(len(sets)):
            self._insert(i, self.ids[self.starts[i] : self.starts[i] + self.sizes[i]])
        self.branches = []  # parents before children
        stack = [self.root]
        while stack:
            branch = stack.pop()
            self.branches.append(branch)
            stack += branch.children.values()

    def find(self, x: int) -> int:
        """The first member of the component."""
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _insert(self, me: int, grams: np.ndarray) -> None:
        branch, at, size = self.root, 0, len(grams)
        branch.least, branch.largest = min(branch.least, size), max(branch.largest, size)
        while at < size:
            head = int(grams[at])
            child = branch.children.get(head)
            if child is None:
                child = branch.children[head] = _Branch(grams[at:], me)
                at = size
            else:
                m = min(len(child.grams), size - at)
                differ = np.flatnonzero(child.grams[:m] != grams[at : at + m])
                common = int(differ[0]) if len(differ) else m
                if common < len(child.grams):
                    upper = _Branch(child.grams[:common], child.first)
                    upper.least, upper.largest = child.least, child.largest
                    child.grams = child.grams[common:]
                    upper.children[int(child.grams[0])] = child
                    branch.children[head] = child = upper
                at += common
            child.least, child.largest = min(child.least, size), max(child.largest, size)
            branch = child
        branch.members.append(me)

    def link(self) -> None:
        """Find the components: a few sets go down the tree first, as their links spare others the way."""
        most = max(1, min(512, self.TABLE_BYTES // max(self.n_grams, 1)))
        at, n = 0, 1
        while at < len(self.sizes):
            self._go_down(np.arange(at, min(at + n, len(self.sizes))))
            at, n = at + n, min(4 * n, most)

    def _go_down(self, batch: np.ndarray) -> None:
        percent = self.percent
        has = np.zeros((len(batch), self.n_grams), np.uint8)
        for row, i in enumerate(batch.tolist()):
            has[row, self.ids[self.starts[i] : self.starts[i] + self.sizes[i]]] = 1
        component = np.array([self.find(i) for i in range(len(self.sizes))])
        for branch in reversed(self.branches):
            below = {c.sole for c in branch.children.values()} | {int(component[m]) for m in branch.members}
            branch.sole = below.pop() if len(below) == 1 else -1
        stack = [(self.root, np.arange(len(batch)), np.zeros(len(batch), np.int64), 0)]
        while stack:
            branch, rows, shared, depth = stack.pop()
            me = batch[rows]
            size = self.sizes[me]
            stays = (branch.largest * 100 >= percent * size) & (branch.least * percent <= 100 * size)
            stays &= (component[me] != branch.sole) & (me > branch.first)
            if not stays.all():
                rows, shared, me, size = rows[stays], shared[stays], me[stays], size[stays]
            if not len(rows):
                continue
            self.visited += len(rows)
            if len(branch.grams):
                shared = shared + has[rows[:, None], branch.grams].sum(1, dtype=np.int64)
                depth += len(branch.grams)
                passed = np.searchsorted(self.ordered, me * self.n_grams + branch.grams[-1], "right") - self.starts[me]
                # The size below that fits best has as many n-grams left as the set itself.
                left = size - passed
                best = np.clip(depth + left, branch.least, branch.largest)
                stays = shared + np.minimum(left, best - depth) >= _needed(size + best, percent)
                if not stays.all():
                    rows, shared, me, size = rows[stays], shared[stays], me[stays], size[stays]
                if not len(rows):
                    continue
            if branch.members:
                for one in me[shared >= _needed(size + depth, percent)].tolist():
                    for other in branch.members:
                        a, b = sorted((self.find(one), self.find(other)))
                        self.parent[b] = a
            stack += [(child, rows, shared, depth) for child in branch.children.values()]


def _join_blocks(percent: int) -> Callable[[Batches], Batches]:
    """Rows (block, key, grams) in order: (a, b) for every key that is not the least of its component."""

    def joined(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        tree = PrefixTree(sets, percent)
        tree.link()
        root = [tree.find(i) for i in range(len(keys))]
        found = [i for i, r in enumerate(root) if i != r]
        columns = [[keys[i] for i in found], [keys[root[i]] for i in found]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    def run(batches: Batches) -> Batches:
        keys, sets, block = [], [], None
        for batch in batches:
            data, offsets = as_bytes(batch.column("grams"))
            for i, (b, k) in enumerate(zip(batch.column("block").to_pylist(), batch.column("key").to_pylist())):
                if b != block:
                    if keys:
                        yield joined(keys, sets)
                    keys, sets, block = [], [], b
                keys.append(k)
                sets.append(np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), "<u8"))
        if keys:
            yield joined(keys, sets)

    return run


def _sets(n: int) -> Callable[[Batches], Batches]:
    """(block, key, grams): the sets as packed 64-bit numbers."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            for first, last in steps(offsets):
                a, b = offsets[first], offsets[last]
                sets = ngram_sets(data[a:b], offsets[first : last + 1] - a, n)
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("block"), rows.column("key"), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                    names=["block", "key", "grams"],
                )

    return run


def _summary(n: int) -> Callable[[Batches], Batches]:
    """(key, doc_id, n_grams, s1, s2): the size of each set and 128 bits that stand for it."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            sizes, ones, twos = [], [], []
            for first, last in steps(offsets):
                a, b = offsets[first], offsets[last]
                for grams in ngram_sets(data[a:b], offsets[first : last + 1] - a, n):
                    sizes.append(len(grams))
                    ones.append(int(grams.sum(dtype=np.uint64).view(np.int64)))
                    twos.append(int(mix(grams ^ _MIX_SIZE).sum(dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (sizes, ones, twos))],
                names=["key", "doc_id", "n_grams", "s1", "s2"],
            )

    return run


def _send_first(n: int, percent: int) -> Callable[[Batches], Batches]:
    """Rows (0, more than one, n-gram, key), one for each n-gram and task, and (1, shared, key, key).

    The second kind says how many of a document's n-grams others in the task have too.
    """

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> Batches:
        gram, key = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((key, gram))
        gram, key = gram[order], key[order]
        new = np.ones(len(gram), bool)
        new[1:] = gram[1:] != gram[:-1]
        first = np.flatnonzero(new)
        several = np.diff(first, append=len(gram)) > 1
        yield from _sent(_pairs(0, several.astype(np.int64), gram[first], key[first]))
        keys, counts = np.unique(key[np.repeat(several, np.diff(first, append=len(gram)))], return_counts=True)
        yield from _sent(_pairs(1, counts, keys, keys))

    def run(batches: Batches) -> Batches:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            data, offsets = as_bytes(batch.column("text"))
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for first, last in steps(offsets):
                a, b = offsets[first], offsets[last]
                for i, grams in enumerate(ngram_sets(data[a:b], offsets[first : last + 1] - a, n), first):
                    if len(grams):
                        sent = _first_grams(grams, percent).view(np.int64)
                        held.append((sent, np.full(len(sent), keys[i])))
                        count += len(sent)
                    if count >= LOCAL:
                        yield from summed(held)
                        count = 0
        if held:
            yield from summed(held)

    return run


def _count_shared(batches: Batches) -> Batches:
    """Rows in order of (kind, n-gram): (1, shared, key, key), for n-grams that several tasks have too."""
    last = None  # the n-gram before, its row if that has not been counted
    for batch in batches:
        kind, number, gram, key = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if (kind == 1).any():
            yield batch.filter(pa.array(kind == 1))
        chosen = kind == 0
        several, gram, key = number[chosen] > 0, gram[chosen], key[chosen]
        if not len(gram):
            continue
        if last is not None:
            several, gram, key = (np.concatenate([[x], y]) for x, y in zip(last, (several, gram, key)))
        same = gram[1:] == gram[:-1]
        shared = np.zeros(len(gram), bool)
        shared[1:] |= same
        shared[:-1] |= same
        # A row that is known to be shared needs no count; the last one goes on, as known or not.
        counted = shared & ~several
        last = (bool(several[-1] or shared[-1]), gram[-1], key[-1])
        keys, counts = np.unique(key[counted], return_counts=True)
        yield _pairs(1, counts, keys, keys)


def _sharing(docs: DataFrame, summary: DataFrame, n: int, percent: int) -> DataFrame:
    """(key) of the documents that share so many of their first n-grams as a linked pair does."""
    sent = docs.select("key", "text").mapInArrow(_send_first(n, percent), _PAIR_ROWS)
    met = sent.repartition("a").sortWithinPartitions("kind", "a").mapInArrow(_count_shared, _PAIR_ROWS)
    shared = met.groupBy(F.col("b").alias("key")).agg(F.sum("block").alias("shared"))
    # The smaller of two linked sets has at least percent / 100 of the n-grams of the larger.
    needed = F.ceil(F.col("n_grams") * _MORE * percent / 10_000)
    return shared.join(summary.select("key", "n_grams"), "key").where(F.col("shared") >= needed).select("key")


def _thin_out(docs: DataFrame, members: DataFrame, n: int, percent: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Take apart blocks of more than ``crowd`` n-grams: (members in small blocks, links found on the way).

    ``members`` are (key, block, n_grams).

    Each round compares the sets of a large block with a few of them, its pivots. Those linked
    with a pivot share its component, and one of them goes unless it is so near to a set that is
    not linked with this pivot that the two could be linked (distances obey the triangle
    inequality). What stays is dealt into blocks by other hashes: documents tied by chance part,
    linked ones never do. A round takes at least the pivots out of every large block.
    """
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    small, seed = members.limit(0), 1
    while True:
        sizes = members.groupBy("block").agg(F.sum("n_grams").alias("held"), F.count("*").alias("sets"))
        crowded = materialize(sizes.where((F.col("held") > crowd) & (F.col("sets") > 1)).select("block"), "crowded")
        if crowded.isEmpty():
            return small.unionByName(members), links
        crowded = broadcast_if_small(crowded)
        small = small.unionByName(members.join(crowded, "block", "left_anti"))
        large = materialize(members.join(crowded, "block", "left_semi"), "large")
        texts = docs.join(broadcast_if_small(large.select("key", "block")), "key").select("block", "key", "text")
        sets = materialize(texts.mapInArrow(_sets(n), "block long, key long, grams binary"), "large-blocks")
        rank = F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "key"), "key"))
        chosen = sets.select("block", "key", rank.alias("rank")).where(F.col("rank") <= PIVOTS).select("block", "key")
        pivots = sets.join(broadcast_if_small(materialize(chosen, "pivots")), ["block", "key"]).groupBy("block").agg(
            F.collect_list(F.struct("key", "grams")).alias("pivots")
        )
        scored = sets.join(broadcast_if_small(materialize(pivots, "pivots"), 100), "block").mapInArrow(
            _score, "block long, key long, pivot long, shared long, together long"
        )
        linked = F.col("shared") * 100 >= F.col("together") * percent
        scored = materialize(
            scored.withColumn("linked", linked).withColumn("far", 1 - F.col("shared") / F.col("together")), "scores"
        )
        outside = scored.groupBy("block", "pivot").agg(F.min(F.when(~F.col("linked"), F.col("far"))).alias("nearest"))
        # A little more than the distance of a link, for rounding.
        border = F.col("far") >= F.col("nearest") - (100 - percent) / 100 - 1e-9
        done = F.col("linked") & (~F.coalesce(border, F.lit(False)) | (F.col("key") == F.col("pivot")))
        stay = (
            scored.join(broadcast_if_small(materialize(outside, "outside")), ["block", "pivot"])
            .groupBy("block", "key").agg(F.max(done.cast("int")).alias("done")).where("done = 0")
        )
        found = scored.where(F.col("linked") & (F.col("key") != F.col("pivot")))
        links = links.unionByName(found.select(F.col("key").alias("a"), F.col("pivot").alias("b")))
        left = docs.join(broadcast_if_small(materialize(stay.select("key", "block"), "members")), "key")
        dealt = _blocks(left.select("key", "block", "text"), n, percent, seed)
        members = materialize(dealt.join(large.select("key", "n_grams"), "key"), "members")
        seed += 1


def _score(batches: Batches) -> Batches:
    """Of every set with every pivot of its block: the sizes of intersection and union."""
    for batch in batches:
        data, offsets = as_bytes(batch.column("grams"))
        block, key, pivot, shared, together = [], [], [], [], []
        for i, (b, k) in enumerate(zip(batch.column("block").to_pylist(), batch.column("key").to_pylist())):
            grams = np.frombuffer(data[offsets[i] : offsets[i + 1]].tobytes(), "<u8")
            for other in batch.column("pivots")[i].as_py():
                with_it = np.frombuffer(other["grams"], "<u8")
                both = len(np.intersect1d(grams, with_it, assume_unique=True))
                block.append(b)
                key.append(k)
                pivot.append(other["key"])
                shared.append(both)
                together.append(len(grams) + len(with_it) - both)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (block, key, pivot, shared, together)],
            names=["block", "key", "pivot", "shared", "together"],
        )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, crowd: int = CROWD
) -> DataFrame:
    """One row per document: key, doc_id, n_grams (size of its set), component (least key linked with it).

    Keys are those of :func:`assayer.llm.common.with_row_key`: the ids themselves, where distinct.
    """
    docs = with_row_key(docs, doc_id, text)
    summary = materialize(docs.mapInArrow(_summary(n), "key long, doc_id long, n_grams long, s1 long, s2 long"), "set-sizes")
    same = ["n_grams", "s1", "s2"]
    kinds = materialize(summary.where("n_grams > 0").groupBy(*same).agg(F.min("key").alias("key")), "kinds")
    sending = docs
    if percent < WHOLE_PARTS:
        # Of documents with the same set one is enough.
        sharing = _sharing(docs, summary, n, percent).join(kinds.select("key"), "key", "left_semi")
        sharing = materialize(sharing, "sharing")
        sending = docs.join(broadcast_if_small(sharing), "key", "left_semi")
    blocks = _blocks(sending.select("key", F.lit(0).cast("long").alias("block"), "text"), n, percent, 0)
    members = blocks.join(kinds.select("key", "n_grams"), "key")
    several = members.groupBy("block").count().where("count > 1").select("block")
    members = materialize(members.join(several, "block", "left_semi").select("key", "block", "n_grams"), "members")
    members, links = _thin_out(docs, members, n, percent, crowd)
    members = materialize(members.select("key", "block"), "members")
    sets = docs.select("key", "text").join(broadcast_if_small(members), "key").select("block", "key", "text")
    sets = sets.mapInArrow(_sets(n), "block long, key long, grams binary")
    joined = sets.repartition("block").sortWithinPartitions("block", "key").mapInArrow(_join_blocks(percent), "a long, b long")
    stars = components(joined.unionByName(links))
    named = kinds.join(stars.select(F.col("a").alias("key"), F.col("b").alias("least")), "key", "left")
    named = named.select(*same, F.coalesce("least", "key").alias("component"))
    return summary.join(named, same, "left").select(
        "key", "doc_id", "n_grams", F.coalesce("component", "key").alias("component")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The documents that are the least of their component, one for each group, as they are."""
    keyed, key = row_keyed(docs, doc_id, text)
    kept = near_duplicates(keyed, key, text, **options).where("key = component")
    return keyed.join(kept.select(F.col("key").alias(key)), key, "left_semi").select(*docs.columns)
