"""Prefix tries of conversations: who shares which first turns, and what that saves.

A turn is known by a mark (a 128-bit hash of its role and text, and the text's length in bytes), so
texts are read once and never shuffled. A conversation is its marks in order, cut into pieces of at
most ``PIECE`` turns. Pieces with equal turns behind equal turns are put together with the number of
their conversations before they go anywhere, so copies weigh nothing.

Pieces are dealt to shards by a prefix: one turn where few turns stand behind it, twice as many
again and again where many do. In a shard, turns are numbered densely and a double-array trie
(:class:`DoubleArray`) holds all pieces; they are walked through BASE and CHECK to count what passes
each node. Nodes above a shard's prefix are shared with other shards: their counts are added up as a
table, and what hangs below them climbs to the top in rounds that double the step, so their number is
the logarithm of the prefixes' length. Longer conversations than a piece hang the tries of their
later pieces below the ends of the former ones.

Ids of the conversations that end at a node, of which there may be very many, are joined into texts
of some thousand ids side by side, and only these texts pass through one hash in order.

Null roles and texts are empty; equal turn numbers of a conversation are in the order of their
marks, null numbers first; repeated rows are turns of their own. Rows without a conversation id
belong to no conversation. A conversation without turns is a member of the root alone. An empty
table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.operators.positions import with_position
from assayer.session import broadcast_if_small, materialize

# Turns of a conversation that stand in one row.
PIECE = 1 << 18

# Turns of distinct pieces behind one prefix that go to one shard, at most and at least.
SHARD_TURNS, LEAST_TURNS = 200_000, 256

# Ids that are joined into one text before they are hashed in order.
CHUNK_IDS = 4_096

# Characters of a mark: 128 bits of hash and the text's length in bytes, in hexadecimal.
_HASH, _LENGTH = 32, 12
_MARK = _HASH + _LENGTH

# Places that are tried for a node's children before they go to the end of the arrays.
_TRIES = 200

NOTHING = hashlib.sha256(b"").hexdigest()

_COMPLETE, _EDGE, _UPPER = 0, 1, 2
_NODE = pa.schema([
    ("kind", pa.int32()), ("depth", pa.int64()), ("key", pa.string()), ("parent_key", pa.string()), ("root", pa.string()),
    ("spot", pa.string()), ("end_hash", pa.string()), ("conv", pa.int64()), ("parent_conv", pa.int64()), ("n", pa.int64()),
    ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("size", pa.int64()),
    ("below_children", pa.int64()), ("below_leaves", pa.int64()), ("below_saved", pa.int64()),
])
_NODE_SQL = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'int' if f.type == pa.int32() else 'long'}" for f in _NODE)
_BELOW = ("below_children", "below_leaves", "below_saved")

RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def mark(role: Column, text: Column) -> Column:
    """A turn's mark; null counts as empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    hashed = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return F.concat(hashed, F.lpad(F.hex(F.octet_length(text).cast("long")), _LENGTH, "0"))


def marked_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, mark): the turns of every conversation, numbered from 0. A written table."""
    slim = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), mark(F.col(role), F.col(text)).alias("mark")
    )
    return materialize(with_position(slim, ["turn", "mark"], within=["conv"], name="at").select("conv", "at", "mark"), "turns")


def with_lent_heads(turns: DataFrame, heads: int = 9, family: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their family: (conv, at, mark), and those left without turns.

    Conversation c takes h = crc32(c) modulo ``heads`` turns of conversation c - c modulo ``family`` (fewer if it has
    fewer, none if there is none), and goes on with its own turns after its first h.
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("own"))
    lent = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    first = turns.where(F.col("at") < heads - 1).groupBy(F.col("conv").alias("base"))
    first = first.agg(F.sort_array(F.collect_list(F.struct("at", "mark")))["mark"].alias("head"))
    based = convs.withColumn("h", lent).withColumn("base", F.col("conv") - F.pmod("conv", F.lit(family)))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.array().cast("array<string>"))
    based = materialize(based.join(first, "base", "left").select("conv", "own", "h", head.alias("head")), "heads")
    moved = based.where(F.size("head") < F.col("h")).select("conv", (F.size("head") - F.col("h")).alias("shift"))
    own = turns.where(F.col("at") >= lent).join(moved, "conv", "left")
    own = own.select("conv", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("at"), "mark")
    taken = based.select("conv", F.posexplode("head").alias("at", "mark")).select("conv", F.col("at").cast("long"), "mark")
    turnless = based.where((F.size("head") == 0) & (F.col("own") <= F.col("h"))).select("conv")
    return own.unionByName(taken), turnless


class DoubleArray:
    """A static trie over sequences of small numbers: child c of node s is t = base[s] + c where check[t] = s.

    Nodes with several children are placed first, those with most of them before all; nodes with one child
    fill the places left free. Node 0 is the start.
    """

    def __init__(self, sequences: list[np.ndarray], symbols: int) -> None:
        lengths = np.array([len(s) for s in sequences], np.int64)
        self.flat = np.concatenate([np.zeros(0, np.int64), *sequences])
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.lengths = lengths
        at = np.zeros(len(sequences), np.int64)
        parents, codes, n = [np.array([-1])], [np.array([-1])], 1
        self.by_depth = [np.array([0])]
        for d in range(int(lengths.max(initial=0))):
            active = np.flatnonzero(lengths > d)
            pairs, index = np.unique(at[active] * symbols + self.flat[self.starts[active] + d], return_inverse=True)
            at[active] = n + index
            parents.append(pairs // symbols)
            codes.append(pairs % symbols)
            self.by_depth.append(np.arange(n, n + len(pairs)))
            n += len(pairs)
        parents, codes = np.concatenate(parents), np.concatenate(codes)
        self._place(parents, codes)

    def _place(self, parents: np.ndarray, codes: np.ndarray) -> None:
        n = len(parents)
        order = np.argsort(parents[1:], kind="stable") + 1
        owners, first, count = np.unique(parents[order], return_index=True, return_counts=True)
        base, slot = np.zeros(n, np.int64), np.zeros(n, np.int64)
        free = np.ones(n + int(codes.max(initial=0)) + 2, bool)
        free[0] = False
        tried_from = 1
        several = np.flatnonzero(count > 1)
        for i in several[np.argsort(-count[several], kind="stable")]:
            own = order[first[i] : first[i] + count[i]]
            wanted = codes[own]
            low, high = int(wanted.min()), int(wanted.max())
            while tried_from < len(free) and not free[tried_from]:
                tried_from += 1
            place = tried_from - low
            for place in range(place, place + _TRIES):
                if place + high >= len(free):
                    free = np.concatenate([free, np.ones(max(len(free), place + high + 1 - len(free)), bool)])
                if free[place + wanted].all():
                    break
            else:
                place = len(free) - low
                free = np.concatenate([free, np.ones(high - low + 1, bool)])
            base[owners[i]] = place
            slot[own] = place + wanted
            free[slot[own]] = False
        single = np.flatnonzero(count == 1)
        if len(single):
            if free.sum() < len(single):
                free = np.concatenate([free, np.ones(len(single), bool)])
            only = order[first[single]]
            slot[only] = np.flatnonzero(free)[: len(single)]
            base[owners[single]] = slot[only] - codes[only]
        size = int(slot.max(initial=0)) + 1
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parents[1:]]
        self.by_depth = [slot[nodes] for nodes in self.by_depth]

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth after depth, the sequences that reach it and the nodes they are at."""
        at = np.zeros(len(self.lengths), np.int64)
        for d in range(len(self.by_depth) - 1):
            active = np.flatnonzero(self.lengths > d)
            to = self.base[at[active]] + self.flat[self.starts[active] + d]
            if (self.check[to] != at[active]).any():
                raise AssertionError("A sequence has left the trie")
            at[active] = to
            yield active, to


def _shard(table: pa.Table, offset: int) -> pa.Table:
    """The nodes of one shard's pieces: complete ones, those right below shared ones, and shared ones in part."""
    rows = table.to_pydict()
    contents = rows["content"]
    marks = np.frombuffer("".join(contents).encode(), f"S{_MARK}")
    turns, dense = np.unique(marks, return_inverse=True)
    roots, root_ids = np.unique(np.array(rows["root"], dtype=object), return_inverse=True)
    ends = np.cumsum([len(c) // _MARK for c in contents])
    sequences = [
        np.concatenate([[len(turns) + r], dense[e - len(c) // _MARK : e]]) for c, e, r in zip(contents, ends, root_ids)
    ]
    trie = DoubleArray(sequences, len(turns) + len(roots))
    sizes = np.array([int(t[_HASH:], 16) for t in turns.tolist()] + [0] * len(roots), np.int64)

    size = len(trie.check)
    n, last, upper_to = (np.zeros(size, np.int64) for _ in range(3))
    conv = np.full(size, np.iinfo(np.int64).max)
    example, ending = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    copies, firsts, split = (np.array(rows[c], np.int64) for c in ("n", "first", "m"))
    for d, (active, at) in enumerate(trie.walk()):
        np.add.at(n, at, copies[active])
        np.minimum.at(conv, at, firsts[active])
        np.maximum.at(upper_to, at, split[active])
        example[at] = active
        last[at] = sizes[trie.flat[trie.starts[active] + d]]
        over = trie.lengths[active] == d + 1
        ending[at[over]] = active[over]

    below = {c: np.array([x or 0 for x in rows[c]], np.int64) for c in _BELOW}
    children = np.bincount(trie.check[trie.check >= 0], minlength=size)
    below = {c: np.where(ending >= 0, values[ending], 0) for c, values in below.items()}
    depths = trie.by_depth[1:]
    upper = np.zeros(size, bool)
    for d, nodes in enumerate(depths):
        upper[nodes] = d < upper_to[nodes]
    every = children + below["below_children"]
    leaves = np.where(upper, 0, np.where(every == 0, 1, below["below_leaves"]))
    saved = np.where(upper, 0, (n - 1) * last + below["below_saved"])
    for nodes in reversed(depths[1:]):
        np.add.at(leaves, trie.check[nodes], leaves[nodes])
        np.add.at(saved, trie.check[nodes], saved[nodes])

    nodes = np.concatenate(depths)
    depth = np.repeat(np.arange(len(depths)), [len(x) for x in depths])
    parents = trie.check[nodes]
    is_edge = ~upper[nodes] & (depth > 0) & upper[parents]
    keys = {
        int(v): hashlib.md5(f"{rows['root'][example[v]]}:{contents[example[v]][: d * _MARK]}".encode()).hexdigest()
        for v, d in zip(nodes[upper[nodes]], depth[upper[nodes]])
    }
    no_parent = (depth == 0) | is_edge | upper[nodes]
    at_end = ending[nodes]
    columns = {
        "kind": np.where(upper[nodes], _UPPER, np.where(is_edge, _EDGE, _COMPLETE)),
        "depth": depth + offset,
        "key": [keys.get(v) for v in nodes.tolist()],
        "parent_key": [keys.get(p) for p in np.where(depth > 0, parents, -1).tolist()],
        "root": [rows["root"][example[v]] if d == 0 else None for v, d in zip(nodes.tolist(), depth.tolist())],
        "spot": [rows["spot"][i] if i >= 0 else None for i in at_end.tolist()],
        "end_hash": [rows["end_hash"][i] if i >= 0 else None for i in at_end.tolist()],
        "conv": conv[nodes],
        "parent_conv": pa.array(conv[np.where(no_parent, 0, parents)], mask=no_parent),
        "n": n[nodes], "children": every[nodes], "leaves": leaves[nodes], "saved": saved[nodes], "size": last[nodes],
        **{c: below[c][nodes] for c in _BELOW},
    }
    return pa.table({f.name: pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in _NODE}, schema=_NODE)


def _sharded(offset: int) -> Callable[[pa.Table], pa.Table]:
    return lambda pieces: _shard(pieces, offset)


def _prefix_key(turns: Column | None = None) -> Column:
    """The id of a place: what came before the piece, and the piece or a beginning of it."""
    return F.md5(F.concat("root", F.lit(":"), F.col("content") if turns is None else F.substring(F.col("content"), F.lit(1), turns)).cast("binary"))


def _pieces(turns: DataFrame, turnless: DataFrame | None, piece: int) -> DataFrame:
    """(conv, level, root, content, reached, ends, spot): the marks of at most ``piece`` turns a row. A written table."""
    grouped = turns.groupBy("conv", F.floor(F.col("at") / piece).cast("int").alias("level")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("at", "mark")))["mark"], "").alias("content")
    )
    if turnless is not None:
        grouped = grouped.unionByName(turnless.select("conv", F.lit(0).alias("level"), F.lit("").alias("content")))
    grouped = materialize(grouped, "pieces")
    if not (grouped.agg(F.max("level")).first()[0] or 0):
        return grouped.withColumns({"root": F.lit(""), "reached": F.lit(""), "ends": F.lit(1)}).withColumn("spot", _prefix_key())
    order = Window.partitionBy("conv").orderBy("level")
    so_far = F.collect_list(F.md5(F.col("content").cast("binary"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    chained = grouped.select(
        "*", so_far.alias("chain"), F.when(F.lead("level").over(order).isNull(), 1).otherwise(0).alias("ends")
    )
    name = lambda chain: F.md5(F.array_join(chain, "").cast("binary"))
    before = F.slice("chain", F.lit(1), F.size("chain") - 1)
    chained = chained.select(
        "conv", "level", "content", "ends", name(F.col("chain")).alias("reached"),
        F.when(F.col("level") == 0, "").otherwise(name(before)).alias("root"),
    )
    return materialize(chained.withColumn("spot", _prefix_key()), "pieces")


def _many_ends(pieces: DataFrame, distinct: DataFrame) -> DataFrame | None:
    """(spot, hash) for places where more than one conversation ends; None if there are none."""
    spots = distinct.where("n_ends > 1").select("spot")
    if spots.isEmpty():
        return None
    ending = pieces.where("ends = 1").select("spot", "conv").join(spots, "spot", "left_semi")
    ordered = ending.repartitionByRange("spot", "conv").sortWithinPartitions("spot", "conv")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, ids, first = None, [], None

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"spot": [spot], "first": pa.array([first], pa.int64()), "ids": [",".join(map(str, ids))]})

        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (s != spot or len(ids) == CHUNK_IDS):
                    yield full()
                    ids = []
                if not ids:
                    spot, first = s, c
                ids.append(c)
        if ids:
            yield full()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, state = None, None
        for batch in batches:
            for s, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if s != spot:
                    if spot is not None:
                        yield pa.RecordBatch.from_pydict({"spot": [spot], "hash": [state.hexdigest()]})
                    spot, state = s, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if spot is not None:
            yield pa.RecordBatch.from_pydict({"spot": [spot], "hash": [state.hexdigest()]})

    texts = ordered.mapInArrow(chunks, "spot string, first long, ids string")
    in_order = texts.repartition("spot").sortWithinPartitions("spot", "first")
    return in_order.mapInArrow(hashes, "spot string, hash string")


def _dealt(rows: DataFrame, limit: int, shards: int) -> DataFrame:
    """``rows`` with the prefix length ``m`` above which their nodes are shared, and their ``shard``."""
    dealt, active, m = [], rows, 1
    while True:
        keyed = active.withColumn("group", _prefix_key(F.lit(m * _MARK))).withColumn("m", F.lit(m))
        load = F.sum(F.length("content") / _MARK)
        heavy = keyed.groupBy("group").agg(load.alias("load"), F.count("*").alias("pieces"))
        heavy = materialize(heavy.where((F.col("load") > limit) & (F.col("pieces") > 1)).select("group"), "heavy-prefixes")
        if heavy.isEmpty():
            dealt.append(keyed)
            break
        heavy = broadcast_if_small(heavy)
        dealt.append(keyed.join(heavy, "group", "left_anti"))
        active = keyed.join(heavy, "group", "left_semi").drop("group", "m")
        m *= 2
    united = reduce(DataFrame.unionByName, dealt)
    return united.withColumn("shard", F.pmod(F.xxhash64("group"), F.lit(shards)))


def _climbed(upper: DataFrame) -> DataFrame:
    """``upper`` with ``leaves`` and ``saved`` of all shared nodes below added: own values climb 1, 2, 4 ... steps."""
    sums = upper.select("key", F.col("parent_key").alias("above"), "own_leaves", "own_saved")
    while not sums.where("above IS NOT NULL").isEmpty():
        sums = materialize(sums, "climbing")
        given = sums.where("above IS NOT NULL").groupBy(F.col("above").alias("key")).agg(
            F.sum("own_leaves").alias("more_leaves"), F.sum("own_saved").alias("more_saved")
        )
        further = sums.select(F.col("key").alias("above"), F.col("above").alias("further"))
        more = lambda name: (F.col(f"own_{name}") + F.coalesce(f"more_{name}", F.lit(0))).alias(f"own_{name}")
        sums = sums.join(given, "key", "left").join(further, "above", "left").select(
            "key", F.col("further").alias("above"), more("leaves"), more("saved")
        )
    total = sums.select("key", F.col("own_leaves").alias("l"), F.col("own_saved").alias("s"))
    return upper.join(total, "key").withColumns({"leaves": F.col("leaves") + F.col("l"), "saved": F.col("saved") + F.col("s")}).drop("l", "s")


def _shared(nodes: DataFrame, entered: DataFrame | None) -> DataFrame:
    """Shared nodes, summed over the shards, with the numbers of their children and of what is below."""
    parts = nodes.where(F.col("kind") == _UPPER)
    most = ("parent_key", "root", "spot", "end_hash", "size", *_BELOW)
    upper = parts.groupBy("key", "depth").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        *(F.max(c).alias(c) for c in most),
    )
    if entered is not None:
        # The conversations that end where a later piece begins belong to its start as well.
        known = upper.join(entered, "root", "left").withColumn("conv", F.coalesce("entered", "conv"))
        upper = known.select(*upper.columns)
    upper = materialize(upper, "shared-nodes")
    edges = nodes.where((F.col("kind") == _EDGE)).select("parent_key").unionByName(upper.where("parent_key IS NOT NULL").select("parent_key"))
    counted = edges.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("found"))
    upper = upper.join(counted, "key", "left").withColumn("children", F.coalesce("found", F.lit(0)) + F.col("below_children")).drop("found")
    upper = upper.withColumn("own_leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("below_leaves")))
    upper = materialize(upper.withColumn("own_saved", (F.col("n") - 1) * F.col("size") + F.col("below_saved")), "shared-nodes")
    return materialize(_climbed(upper), "shared-nodes")


def prefix_nodes(turns: DataFrame, turnless: DataFrame | None = None, piece: int = PIECE, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of (conv, at, mark) and the ids of conversations without turns: columns ``RESULT``.

    ``at`` numbers the turns of a conversation from 0 without gaps.
    """
    spark = turns.sparkSession
    pieces = _pieces(turns, turnless, piece)
    ended = F.col("ends") == 1
    distinct = pieces.groupBy("level", "root", "content").agg(
        F.count("*").alias("n"), F.min("conv").alias("first"), F.sum("ends").alias("n_ends"),
        F.min(F.when(ended, F.col("conv"))).alias("end_first"), F.max("reached").alias("reached"), F.max("spot").alias("spot"),
    )
    one = F.when(F.col("n_ends") == 0, NOTHING).when(F.col("n_ends") == 1, F.sha2(F.col("end_first").cast("string").cast("binary"), 256))
    distinct = materialize(distinct.withColumn("end_hash", one).drop("end_first"), "distinct-pieces")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found, below = [], None
    for level in range(distinct.agg(F.max("level")).first()[0] or 0, -1, -1):
        rows = distinct.where(F.col("level") == level)
        if below is None:
            rows = rows.withColumns({c: F.lit(0).cast("long") for c in _BELOW})
        else:
            rows = rows.join(below.withColumnRenamed("root", "reached"), "reached", "left")
        total = rows.agg(F.sum(F.length("content") / _MARK)).first()[0] or 0
        shards = max(width, int(total // shard_turns) + 1)
        limit = min(max(int(total / shards), LEAST_TURNS), shard_turns)
        slim = _dealt(rows, limit, shards).select("shard", "root", "content", "n", "first", "spot", "end_hash", "m", *_BELOW)
        offset = level * piece
        nodes = materialize(slim.groupBy("shard").applyInArrow(_sharded(offset), _NODE_SQL), "nodes")
        entered = distinct.where(F.col("level") == level - 1).groupBy(F.col("reached").alias("root")).agg(F.min("first").alias("entered"))
        upper = _shared(nodes, entered if level else None)
        parents = upper.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent"))
        parents = broadcast_if_small(parents)
        edges = nodes.where(F.col("kind") == _EDGE).join(parents, "parent_key").withColumn("parent_conv", F.col("parent"))
        inner = upper.where(F.col("depth") > offset if level else F.lit(True)).join(parents, "parent_key", "left")
        kept = ("depth", "conv", "n", "children", "leaves", "saved", "spot", "end_hash")
        found += [
            nodes.where(F.col("kind") == _COMPLETE).select(*kept, "parent_conv"), edges.select(*kept, "parent_conv"),
            inner.select(*kept, F.col("parent").alias("parent_conv")),
        ]
        below = upper.where(F.col("depth") == offset).select("root", *(F.col(c.removeprefix("below_")).alias(c) for c in _BELOW))
    nodes = reduce(DataFrame.unionByName, found)
    many = _many_ends(pieces, distinct)
    nodes = nodes.withColumn("end_hash", F.when(F.col("spot").isNull(), NOTHING).otherwise(F.col("end_hash")))
    if many is not None:
        missing = nodes.where("end_hash IS NULL").join(many, "spot").withColumn("end_hash", F.col("hash")).drop("hash")
        nodes = nodes.where("end_hash IS NOT NULL").unionByName(missing)
    names = dict(zip(("conv", "depth", "parent_conv", "n", "children", "leaves", "saved", "end_hash"), RESULT))
    return nodes.select(*(F.col(c).alias(name) for c, name in names.items()))
