"""The prefix trie against a plain walk over all prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from siltstone.llm import prefix_trie, queries


def walk(conversations: dict[int, list[tuple[str, str]]]):
    """Rows of the trie of sequences of (role, text)."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
    ends = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(conversations[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], ends(k)) for k, m in members.items())


def rebuild(rows):
    """{conv_id: turns} from (conv_id, turn, role, text) with distinct turns."""
    own = defaultdict(list)
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((r or "", x or ""))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def collected(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def drawn(seed, n, deep=6):
    rng = random.Random(seed)
    base = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None])) for c in range(n) for t in range(rng.randint(0, deep))]
    return [(c, t if t else None, r, x) for c, t, r, x in base]


@pytest.mark.parametrize(("seed", "n", "deep", "partitions"), [(1, 60, 6, 1), (2, 120, 4, 13), (3, 150, 12, 40), (4, 40, 30, 7), (5, 200, 2, 60)])
def test_trie_is_the_walk(spark, seed, n, deep, partitions):
    rows = drawn(seed, n, deep)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n int").repartition(3)
    assert collected(prefix_trie.conversation_trie(df, partitions=partitions)) == walk(rebuild(rows))


@pytest.mark.parametrize("seed", range(20))
def test_sweeping_in_stretches(seed):
    """Stretches of any size: their nodes are the walk's, their fragments' members add up."""
    rng = random.Random(seed)
    name = lambda x: hashlib.md5(x.encode()).digest()
    seqs = {c: [rng.choice("ab") for _ in range(rng.randint(0, 5))] for c in range(40)}
    rows = sorted((b"".join(map(name, s)), c, [1] * len(s)) for c, s in seqs.items())
    whole = list(prefix_trie.sweep(iter(rows), 0))
    assert sum(r[6] for r in whole if r[0] == prefix_trie.FRAGMENT and r[3] == 0) == len(rows)
    found = {(r[3], r[4]): (r[6], r[7]) for r in whole if r[0] in (prefix_trie.NODE, prefix_trie.LOOSE, prefix_trie.FRAGMENT)}
    want = walk({c: [("", x) for x in s] for c, s in seqs.items()})
    assert {k: v[0] for k, v in found.items()} == {(r[1], r[0]): r[3] for r in want}


def test_one_conversation_for_many_ids_spreads(spark):
    rows = [(c * 5, t, "user", f"turn {t}") for c in range(900) for t in range(3)] + [(c * 5 + 2, 0, "user", str(c)) for c in range(100)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert collected(prefix_trie.conversation_trie(df, partitions=16)) == walk(rebuild(rows))


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefix_trie.conversation_trie(empty).count() == 0
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 1, "user", "long " * 30_000), (5, 0, "user", "x"), (5, 0, "user", "x"), (13, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = collected(prefix_trie.conversation_trie(df, partitions=3))
    assert sum(r[1] == 0 for r in got) == 1 and [r for r in got if r[1] == 0][0][3] == 3
    # null and empty texts are one text, and role and text do not run together
    pairs = [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, None, ""), (15, 0, "", None)]
    nodes = collected(prefix_trie.conversation_trie(spark.createDataFrame(pairs, "conv_id long, turn int, role string, text string")))
    assert [r[3] for r in nodes if r[1] == 1] == [1, 1, 2]
    # ties take one order however the rows come
    tied = [(0, 0, "user", x) for x in "qwertz"] + [(5, 0, "user", x) for x in "ztrewq"]
    assert [r[3] for r in collected(prefix_trie.conversation_trie(spark.createDataFrame(tied, "conv_id long, turn int, role string, text string")))] == [2] * 7


def test_long_conversations(spark):
    rows = [(c, t, "user", "same" if t < 700 or c < 10 else f"{c}") for c in (0, 5, 10, 15) for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert collected(prefix_trie.conversation_trie(df, partitions=4)) == walk(rebuild(rows))


def test_query_op13(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in queries.table(spark, sf, "conversations").collect()]
    assert collected(queries.op13_prefix_trie(spark, sf)) == walk(rebuild(rows))
