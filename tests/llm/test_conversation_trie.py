"""Prefix tries of conversations against tries of Python dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from assayer.llm import conversation_trie
from assayer.llm.queries import QUERIES
from plain import rows


def lent(turns):
    """conv_id -> rebuilt turns, from (conv_id, turn, role, text)."""
    own = {}
    for c, _, role, text in sorted(turns, key=lambda t: (t[0], t[1] is not None, t[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}


def slow(conversations):
    """One tuple per node of the trie."""
    members, ends = {}, {}
    for c, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + own
        if node:
            for table, value in ((children, 1), (leaves, leaves[node]), (saved, saved[node])):
                table[node[:-1]] = table.get(node[:-1], 0) + value
    return sorted(
        (members[x][0], len(x), members[x[:-1]][0] if x else -1, len(members[x]), children.get(x, 0), leaves[x], saved[x],
         hashlib.sha256(",".join(map(str, ends.get(x, []))).encode()).hexdigest())
        for x in members
    )


def got(df):
    assert tuple(df.columns) == conversation_trie.RESULT
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def test_query(spark, small):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows(small, "conversations")]
    assert got(QUERIES["op12_conversation_trie"](spark, small)) == slow(lent(turns))


SCHEMA = "conv_id long, turn long, role string, text string, conv string, at int"


@pytest.mark.parametrize("piece,shard_turns", [(1 << 18, 3), (3, 2)])
def test_copies_hot_prefixes_and_pieces(spark, piece, shard_turns):
    """A third are copies, most share seven turns; some are long, nested in each other, or without turns when rebuilt."""
    pick = random.Random(piece + shard_turns)
    shared = [("system", "be kind")] + [("user", f"part {i} é") for i in range(6)]
    turns = []
    for c in range(120):
        if c % 3 == 0:
            body = shared[:4]
        elif c % 7 == 0:
            body = shared + [("user", str(i)) for i in range(pick.randint(0, 14))]
        else:
            body = shared[: pick.randint(0, 7)] + [("user", str(pick.randint(0, 3))) for _ in range(pick.randint(0, 4))]
        turns += [(c + 1000, None if i == 0 and c % 2 else i, *x, "x", 1) for i, x in enumerate(body)]
    turns += [(c, i, "user" if i else None, None, "x", 1) for c in (2001, 2002, 2003, 2004) for i in range(2)] + [(None, 0, "user", "lost", "x", 1)]
    expected = lent([t[:4] for t in turns if t[0] is not None])
    assert [] in expected.values()
    df = spark.createDataFrame(turns, SCHEMA).repartition(5)
    marked = conversation_trie.marked_turns(df)
    result = conversation_trie.prefix_nodes(*conversation_trie.with_lent_heads(marked), piece=piece, shard_turns=shard_turns)
    assert got(result) == slow(expected)


def test_many_ends_in_several_texts(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK_IDS", 3)
    turns = spark.createDataFrame([(c, 0, "user", "hi", "", 0) for c in range(40)], SCHEMA)
    result = conversation_trie.prefix_nodes(conversation_trie.marked_turns(turns))
    assert got(result) == slow({c: [("user", "hi")] for c in range(40)})


def test_empty(spark):
    marked = conversation_trie.marked_turns(spark.createDataFrame([], SCHEMA))
    assert got(conversation_trie.prefix_nodes(*conversation_trie.with_lent_heads(marked))) == []


def test_a_very_long_conversation_and_text(spark):
    body = [("user", "a" * 1_000_000)] + [("user", str(i % 5)) for i in range(20_000)]
    turns = [(c, i, *x, "", 0) for c in (0, 1) for i, x in enumerate(body[: 20_001 - c])]
    result = conversation_trie.prefix_nodes(conversation_trie.marked_turns(spark.createDataFrame(turns, SCHEMA)), piece=9_000)
    found = {r["depth"]: r for r in result.collect()}
    assert len(found) == 20_002 and found[0]["saved_tokens"] == 1_000_000 + 19_999
    assert (found[20_000]["n_convs"], found[20_001]["n_convs"]) == (2, 1)


def test_double_array_holds_what_it_was_given():
    pick = np.random.default_rng(1)
    words = [pick.integers(0, 300, pick.integers(0, 9)) for _ in range(500)] + [np.arange(300)] + [np.array([5, i]) for i in range(300)]
    trie = conversation_trie.DoubleArray(words, 300)
    at = {}
    for d, (active, nodes) in enumerate(trie.walk()):
        for i, node in zip(active, nodes):
            assert at.setdefault(node, tuple(words[i][: d + 1])) == tuple(words[i][: d + 1])
    assert len(at) == len({tuple(w[: d + 1]) for w in words for d in range(len(w))})
    assert len(trie.check) < 3 * len(at) + 600
