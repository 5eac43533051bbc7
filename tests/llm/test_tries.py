"""The prefix trie against a plain one, over orders cut into many blocks."""

import hashlib
import random
import zlib

import pytest

from quillmark.llm import tries


def plain(convs: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    """The contract's nodes of rebuilt conversations, each sequence spelt out."""
    whole = {}
    for c, own in convs.items():
        base, h = c - (abs(c) % 20) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members: dict[tuple, list[int]] = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = set()
    for node, own in members.items():
        sub = [v for v in members if v[: len(node)] == node]
        children = [v for v in sub if len(v) == len(node) + 1]
        leaves = sum(1 for v in sub if not any(len(x) == len(v) + 1 and x[: len(v)] == v for x in members))
        saved = sum((len(members[v]) - 1) * len(v[-1][1].split()) for v in sub if v)
        ends = ",".join(str(c) for c in sorted(c for c in own if len(whole[c]) == len(node)))
        up = min(members[node[:-1]]) if node else None
        out.add((min(own), len(node), up, len(own), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(spark, convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    rows = [(c, k, role, text) for c, turns in convs.items() for k, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return [tuple(r) for r in tries.op13(df).collect()]


@pytest.mark.parametrize(("seed", "n", "letters", "most", "blocks"), [(1, 60, 2, 4, 7), (2, 200, 1, 30, 16), (3, 120, 2, 8, 1), (4, 40, 5, 3, 23)])
def test_random_conversations(spark, seed, n, letters, most, blocks):
    """Few different turns, so prefixes, equal conversations and chains of depths go through the blocks' ends."""
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "bot"][: 1 + letters // 2]), " ".join("ab"[rng.randrange(2)] for _ in range(rng.randrange(letters + 1))))
    convs = {rng.randrange(-50, 10 * n): [turn() for _ in range(rng.randrange(1, most + 1))] for _ in range(n)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    try:
        got = found(spark, convs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) and set(got) == plain(convs)


def test_a_third_is_one_conversation(spark):
    """A run of equal conversations through several blocks, and one conversation with a third of all turns."""
    convs = {c: [("user", "hello there"), ("bot", "hi")] for c in range(20, 80)} | {c: [("user", f"x {c}")] for c in range(100, 160)} | {200: [("user", f"t {k % 7}") for k in range(90)]}
    assert set(found(spark, convs)) == plain(convs)


def test_odd_rows(spark):
    """Null turns first, null role and text empty, ties by role and text, repeated rows turns each, no id no conversation, clashing columns; no rows no nodes."""
    schema = "conv_id long, turn long, role string, text string, depth string, k long, key string, words long"
    odd = [(20, 1, "user", "b", "x", 1, "y", 2), (20, None, None, None, "x", 1, "y", 2), (20, 1, "bot", "z", "x", 1, "y", 2), (None, 0, "user", "lost", "x", 1, "y", 2), (40, 0, "user", "a a", None, None, None, None), (40, 0, "user", "a a", None, None, None, None)]
    got = {tuple(r) for r in tries.op13(spark.createDataFrame(odd, schema)).collect()}
    assert got == plain({20: [("", ""), ("bot", "z"), ("user", "b")], 40: [("user", "a a")] * 2})
    empty = tries.op13(spark.createDataFrame([], schema))
    assert empty.collect() == [] and [c for c, t in empty.dtypes if t == "bigint"] == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def test_turnless_conversations(spark):
    """A conversation shorter than its head, in a group without a first one, has no turns and is a member of the root."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 1)
    for convs in ({c: [("user", "a")]}, {c: [("user", "a")], 41: [("user", "b")] * 5}):
        assert set(found(spark, convs)) == plain(convs)
