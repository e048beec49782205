"""Prefix trie of conversations by vertical bitmaps.

A node of the trie is a distinct sequence of first turns; its members are the
conversations that start with it. Turns that many conversations share need to
be stored and computed once, which is what the trie prices.

Method: a shard holds the turns of up to ``SHARD`` conversations as vertical
bitmaps, an index from (position, turn) to the bitset of the conversations that
have this turn there. Depth first, a node's bitset is intersected with the
postings of the next position: each intersection is a child, its popcount the
child's members, and the intersection with the posting of "no further turn" the
list of conversations that end at the node.

How it is dealt out: conversations are rebuilt from digests, no text is
shuffled. A shard takes ``DEPTHS`` positions at most; a longer conversation goes
on in a shard of the next positions from the node it had reached, so neither a
hot conversation nor a hot first turn is one task's work. A node has a 128-bit
name made of its turns and their positions, so the shards' counts are summed by
that name. A node's smallest member owns it; what a conversation owns is the
lower end of its path, so sums over subtrees are sums along own paths plus one
row for each shared ancestor. Shards are ranges of ids, so the end lists of a
node are pieces in ascending order: they are hashed as they stream by, one
piece in memory.

Edge cases: a null role or text is empty, a null turn comes first, turns of the
same number go by the digest of role and text; rows with a null conv_id belong
to no conversation; a rebuilt conversation without turns is a member of the root
and ends there; an empty table has no root and gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store, stored

#: Conversations and positions of a shard.
SHARD, DEPTHS = 512, 64
#: The rebuilding: heads come from the conversation at the start of each run
#: of BASE ids, of at most HEADS - 1 turns.
BASE, HEADS = 100, 6

LOCAL = "k1 long, k2 long, p1 long, p2 long, depth long, n long, least long, chars long, first_end long, ends binary"


def _digest(role: Column, text: Column) -> Column:
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def ordered_turns(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, h, chars): every turn's digest and place from 0. A range
    sort; a conversation may span partitions, its later parts then get the
    length of the earlier ones added."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    light = store(convs.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), _digest(role, text).alias("h"),
                                                              F.char_length(text).cast("long").alias("chars")), "turns")

    def run(batches: Iterator[pa.RecordBatch]):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids):
                continue
            new = np.concatenate(([last is None or ids[0] != last], ids[1:] != ids[:-1]))
            start = np.where(new, np.arange(len(ids)), -1)
            start = np.maximum.accumulate(start)
            pos = np.where(start >= 0, np.arange(len(ids)) - start, np.arange(len(ids)) + n)
            last, n = ids[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(pos.astype(np.int64)), b.column(1), b.column(2)],
                                             names=["conv_id", "part", "at", "h", "chars"])

    # nulls stand first in an ascending sort
    by = ["conv_id", "turn", "h"]
    placed = store(light.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "h", "chars")
                   .mapInArrow(run, "conv_id long, part int, at long, h binary, chars long"), "placed-turns")
    parts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part")) - F.col("n")
    later = stored(parts.withColumn("before", before).where("before > 0").select("conv_id", "part", "before"), "turns-before").small()
    return placed.join(later, ["conv_id", "part"], "left").select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "h", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, h, chars): the rebuilt conversations, depth from 1, with
    one row more at the end whose ``h`` is null."""
    base = F.col("conv_id") - F.col("conv_id") % BASE
    taken = F.crc32(F.col("conv_id").cast("string")) % HEADS
    heads = (turns.where((F.col("conv_id") % BASE == 0) & (F.col("pos") < HEADS - 1)).groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "h", "chars"))).alias("heads")))  # HEADS - 1 at most
    heads = stored(heads, "heads")
    convs = store(turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("base", base).withColumn("taken", taken), "conversations")
    # a conversation that is its own base is as it was
    lent = (convs.join(heads.small(), "base", "left").select("conv_id", "n", "taken", (F.col("base") == F.col("conv_id")).alias("own"),
                                                             F.when(F.col("base") != F.col("conv_id"), F.slice("heads", 1, F.col("taken").cast("int"))).alias("heads")))
    lent = store(lent.withColumn("lent", F.coalesce(F.size("heads"), F.lit(0))), "lent")
    first = lent.where("lent > 0").select("conv_id", F.posexplode("heads").alias("i", "x")).select(
        "conv_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("x")["h"].alias("h"), F.col("x")["chars"].alias("chars"))
    length = F.when(F.col("own"), F.col("n")).otherwise(F.col("lent") + F.greatest(F.lit(0), F.col("n") - F.col("taken")))
    ends = lent.select("conv_id", (length + 1).alias("depth"), F.lit(None).cast("binary").alias("h"), F.lit(0).cast("long").alias("chars"))
    count = heads.df.select("base", F.size("heads").alias("there"))
    rest = turns.withColumn("base", base).withColumn("taken", taken).where((F.col("base") == F.col("conv_id")) | (F.col("pos") >= F.col("taken")))
    moved = F.when(F.col("base") == F.col("conv_id"), F.col("pos")).otherwise(F.col("pos") - F.col("taken") + F.least("taken", F.coalesce("there", F.lit(0))))
    rest = rest.join(stored(count, "head-counts").small(), "base", "left").select("conv_id", (moved + 1).alias("depth"), "h", "chars")
    return first.unionAll(rest).unionAll(ends)


def named(rows: DataFrame) -> DataFrame:
    """``rows`` with the position block, a 128-bit hash of turn and position,
    and the name (e1, e2) of the node that the conversation reaches before the
    block: the xor of its earlier turns' hashes."""
    rows = store(rows.withColumn("block", F.floor((F.col("depth") - 1) / DEPTHS).cast("long"))
                 .withColumn("x1", F.xxhash64("depth", "h")).withColumn("x2", F.xxhash64(F.lit(1), "h", "depth")), "rebuilt-turns")
    # only conversations of several blocks have an entry
    long_ones = rows.where("block > 0").select("conv_id").distinct()
    per = (rows.where("h is not null").join(stored(long_ones, "long-conversations").small(), "conv_id", "left_semi")
           .groupBy("conv_id", "block").agg(F.expr("bit_xor(x1)").alias("b1"), F.expr("bit_xor(x2)").alias("b2")))
    upto = W.partitionBy("conv_id").orderBy("block")
    entry = per.select("conv_id", (F.col("block") + 1).alias("block"), F.expr("bit_xor(b1)").over(upto).alias("e1"), F.expr("bit_xor(b2)").over(upto).alias("e2"))
    return (rows.join(stored(entry, "entries").small(), ["conv_id", "block"], "left")
            .select("conv_id", "block", "depth", "h", "chars", "x1", "x2", F.coalesce("e1", F.lit(0)).alias("e1"), F.coalesce("e2", F.lit(0)).alias("e2")))


def bitmap_trie(convs: list[list[tuple]], block: int, depths: int = DEPTHS) -> Iterator[tuple]:
    """Rows of ``LOCAL`` for one shard. ``convs``: for each conversation its
    (conv_id, h, chars, x1, x2, e1, e2) at the consecutive positions of the
    block, in ascending order of ids."""
    top = block * depths
    postings: list[dict] = [{} for _ in range(depths + 1)]  # position -> turn -> bitset
    for i, rows in enumerate(convs):
        for at, r in enumerate(rows):
            postings[at][r[1]] = postings[at].get(r[1], 0) | 1 << i
    roots: dict[tuple, int] = {}
    for i, rows in enumerate(convs):
        name = rows[0][5], rows[0][6]
        roots[name] = roots.get(name, 0) | 1 << i
    # (name, parent's name, depth, bitset, code points of the last text)
    stack = [(name, (None, None), top, bits, None) for name, bits in roots.items()]
    while stack:
        name, parent, depth, bits, chars = stack.pop()
        at, rest, ends = depth - top, bits, None
        while rest and at < depths:
            i = (rest & -rest).bit_length() - 1
            _, h, text, x1, x2, _, _ = convs[i][at]
            got = bits & postings[at][h]
            rest &= ~got
            if h is None:
                ends = got
            else:
                stack.append(((name[0] ^ x1, name[1] ^ x2), name, depth + 1, got, text))
        ids = []
        while ends:
            low = ends & -ends
            ids.append(convs[low.bit_length() - 1][0][0])
            ends ^= low
        inner = chars is None and block > 0  # counted by the shard above
        if ids or not inner:
            yield (*name, *parent, depth, 0 if inner else bits.bit_count(), convs[(bits & -bits).bit_length() - 1][0][0], chars,
                   ids[0] if ids else None, np.array(ids, np.int64).tobytes() if ids else None)


def shards(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """The local tries of all shards (``LOCAL``)."""

    def run(batches: Iterator[pa.RecordBatch]):
        def table(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 9 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        names = [c.split()[0] for c in LOCAL.split(", ")]
        held: list[list[tuple]] = []
        block = None
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("block", "conv_id", "h", "chars", "x1", "x2", "e1", "e2")]
            for k, *r in zip(*cols, strict=True):
                if k != block or (len(held) == shard and held[-1][0][0] != r[0]):
                    if held:
                        yield table(list(bitmap_trie(held, block)))
                    held, block = [], k
                if not held or held[-1][0][0] != r[0]:
                    held.append([])
                held[-1].append(tuple(r))
        if held:
            yield table(list(bitmap_trie(held, block)))

    return (rows.repartitionByRange("conv_id", "block").sortWithinPartitions("block", "conv_id", "depth").mapInArrow(run, LOCAL))


def _end_hashes(local: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the pieces of a node's end list stream by in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]):
        name, digest, out = None, None, []
        for b in batches:
            for k1, k2, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (k1, k2) != name:
                    if digest is not None:
                        out.append((*name, digest.hexdigest()))
                    name, digest = (k1, k2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(",".join(map(str, np.frombuffer(cell.as_py(), np.int64).tolist())).encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], names=["k1", "k2", "ends_sha256"])
                out = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name[0]]), pa.array([name[1]]), pa.array([digest.hexdigest()])], names=["k1", "k2", "ends_sha256"])

    pieces = local.where("ends is not null").select("k1", "k2", "first_end", "ends").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first_end")
    return pieces.select("k1", "k2", "ends").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def trie(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, depth, h, chars; see
    :func:`rebuilt`): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    rows = store(named(rows), "trie-turns")
    local = store(shards(rows, shard), "trie-shards")
    nodes = store(local.groupBy("k1", "k2").agg(F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("chars").alias("chars"),
                                                F.max("p1").alias("p1"), F.max("p2").alias("p2")), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = store(nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                  .withColumn("saved", (F.col("n") - 1) * F.coalesce("chars", F.lit(0))).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                  .withColumn("block", F.floor(F.col("depth") / DEPTHS)), "trie-counted")
    # along own paths: sums of the blocks below, and inside the block from the node down
    blocks = nodes.groupBy("least", "block").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"), F.min("depth").alias("top"))
    below = W.partitionBy("least").orderBy(F.col("block").desc())
    blocks = store(blocks.withColumn("below_s", F.sum("s").over(below) - F.col("s")).withColumn("below_l", F.sum("l").over(below) - F.col("l")), "trie-blocks")
    inside = W.partitionBy("least", "block").orderBy(F.col("depth").desc())
    own = (nodes.join(blocks.select("least", "block", "below_s", "below_l"), ["least", "block"])
           .withColumn("own_s", F.col("below_s") + F.sum("saved").over(inside)).withColumn("own_l", F.col("below_l") + F.sum("leaf").over(inside)))
    # to the ancestors that smaller conversations own
    paths = store(blocks.groupBy(F.col("least").alias("conv_id")).agg(F.sum("s").alias("s"), F.sum("l").alias("l"), F.min("top").alias("top")).where("top > 0 and (s > 0 or l > 0)"), "trie-paths")
    above = rows.where("h is not null").join(paths, "conv_id").where("depth < top")
    upto = W.partitionBy("conv_id", "block").orderBy("depth")
    above = above.select(F.expr("bit_xor(x1)").over(upto).bitwiseXOR(F.col("e1")).alias("k1"), F.expr("bit_xor(x2)").over(upto).bitwiseXOR(F.col("e2")).alias("k2"), "s", "l")
    root = paths.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "s", "l")
    lent = above.unionAll(root).groupBy("k1", "k2").agg(F.sum("s").alias("s"), F.sum("l").alias("l"))
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent_conv_id"))
    out = own.join(lent, ["k1", "k2"], "left").join(_end_hashes(local), ["k1", "k2"], "left").join(parents, ["p1", "p2"], "left")
    return out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
                      (F.col("own_l") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("own_s") + F.coalesce("s", F.lit(0))).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def report(convs: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(store(ordered_turns(convs), "ordered-turns")))


#: crc32 of the id's digits: a byte is xored in, then eight shifts (marked -1).
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
  lambda ch: list_concat([CAST(ascii(ch) AS BIGINT)], list_transform(range(8), lambda z: CAST(-1 AS BIGINT)))))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)) END))"""

SQL = f"""
WITH t AS (SELECT conv_id, role, text, sha256(concat(length(role), ':', role, text)) AS h, turn
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(h, 32)) - 1 AS pos FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {BASE} AS base, {_CRC} % {HEADS} AS taken FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, p.pos, p.h, p.text FROM c JOIN p ON p.conv_id = c.base WHERE p.pos < taken
      UNION ALL SELECT conv_id, 1, pos, h, text FROM p JOIN c USING (conv_id) WHERE pos >= taken),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM r),
path AS (SELECT conv_id, depth, length(text) AS chars, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM o
         UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars, left(k, 64 * greatest(depth - 1, 0)) AS up FROM path GROUP BY k, depth),
kids AS (SELECT up AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY up),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, q.conv_id AS parent_conv_id
              FROM node LEFT JOIN kids USING (k) LEFT JOIN node q ON node.depth > 0 AND q.k = node.up),
below AS (SELECT a.k, sum((x.n - 1) * x.chars) AS saved, count(*) FILTER (x.n_children = 0) AS leaves
          FROM full_node a JOIN full_node x ON x.depth >= a.depth AND left(x.k, 64 * a.depth) = a.k GROUP BY a.k),
last AS (SELECT conv_id, arg_max(k, depth) AS k FROM path GROUP BY conv_id),
ends AS (SELECT k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM last GROUP BY k)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent_conv_id, CAST(f.n AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_node f JOIN below b USING (k) LEFT JOIN ends e USING (k)"""
