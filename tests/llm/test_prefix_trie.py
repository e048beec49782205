"""The conversation trie against nested dictionaries."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textguard.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ODD = ([(None, 0, "user", "no conversation"), (-7, 0, "user", "negative"), (-7, 1, None, None), (0, None, "user", "null turn"), (0, 0, "user", "hi"), (0, 1, "bot", "ho 𝔘"),
        (0, 1, "bot", "ho again"), (1, 0, "user", ""), (2, 5, "user", "hi"), (2, 5, "user", "hi"), (3, 0, "us", "erhi"), (3, 1, "user", "x" * 100_000)]
       + [(c, 0, "user", "one turn") for c in range(300, 330)]  # no base: those that lose it have none
       + [(c, t, "user", f"turn {t}") for c in range(500, 530) for t in range(c % 9)])


def test_nodes_by_definition(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"{'shared' if (c * 7 + t) % 3 else c} {t}") for c in range(250) for t in range(c % 8)]
    assert result(prefix_trie.report(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("partitions", [1, 5])
def test_odd_rows(spark, partitions):
    df = frame(spark, ODD).withColumn("depth", F.lit("x")).withColumn("h", F.lit("x")).withColumn("k1", F.lit(1)).repartition(partitions)
    assert result(prefix_trie.report(df)) == brute(ODD)
    assert result(prefix_trie.report(frame(spark, []))) == []


def test_long_conversations_go_on_in_further_blocks(spark):
    rows = []
    for c, n in ((0, 300), (1, 300), (7, 64), (8, 65), (9, 128), (10, 129), (11, 200)):
        rows += [(c, t, "user", "same" if t < 150 or c > 8 else f"{c}") for t in range(n)]
    assert result(prefix_trie.report(frame(spark, rows))) == brute(rows)


def test_small_shards(spark):
    rows = [(c, t, "user", "hello" if t < 3 else f"{c % 5}") for c in range(60) for t in range(1 + c % 6)]
    turns = prefix_trie.rebuilt(prefix_trie.ordered_turns(frame(spark, rows)))
    assert result(prefix_trie.trie(turns, shard=7)) == brute(rows)


def test_hot_conversation(spark):
    """Most conversations are copies of one; many share the first turn."""
    rows = [(c, t, "user", f"copied {t}") for c in range(1500) for t in range(4)]
    rows += [(c, t, "user", "copied 0" if t == 0 else f"own {c} {t}") for c in range(1500, 1700) for t in range(3)]
    assert result(prefix_trie.report(frame(spark, rows))) == brute(rows)


def test_bitmaps_of_one_shard():
    def conv(c, turns):
        return [(c, t, 1, hash(t) % 1000, 7, 0, 0) for t in turns] + [(c, None, 0, 0, 0, 0, 0)]
    out = list(prefix_trie.bitmap_trie([conv(3, "ab"), conv(5, "ab"), conv(9, "a"), conv(11, "c")], 0))
    by = {(r[4], r[6]): (r[5], None if r[9] is None else list(memoryview(r[9]).cast("q"))) for r in out}
    assert by == {(0, 3): (4, None), (1, 3): (3, [9]), (2, 3): (2, [3, 5]), (1, 11): (1, [11])}
