"""Near-duplicate documents by SimHash fingerprints and pigeonhole blocks.

Method: words are runs of anything but white space, A-Z in lower case; the
shingles are all runs of ``SHINGLE`` words joined by a space, repeats included
(a shorter text is one shingle of all its words). A bit of the 64-bit
fingerprint is 1 if it is set in over half of the shingles' XXH64 (seed 42).
Documents are linked if their fingerprints differ in at most ``DISTANCE`` bits,
and linked documents form components.

Pigeonhole: the 64 bits are cut into ``BLOCKS`` = 6 blocks. Three differing
bits touch at most three blocks, so a close pair shares three whole blocks: it
stands in one bucket of at least one of the 20 ways to choose three blocks. The
bucket's members are then compared by their Hamming distance.

How it is dealt out: equal fingerprints are one node, so thousands of copies
are one row of everything that follows. A bucket of more than ``LEAF`` members
(many different texts around one template) is not compared: it is split again
in the same way on its 33 free bits (at most), then on the 18 that are left.
After that 9 bits are free, and no bucket can hold more than 2**9 = ``LEAF``
fingerprints. So no link is lost, a bucket has a proven bound, and the rows
of a fingerprint are bounded however dense its surroundings are. A bucket
returns a link to its smallest member for each of its linked groups (at most
one row per member), never its pairs.

Edge cases: null, empty and blank texts have fingerprint zero and are linked
like any other; a null doc_id links like any other row but gives no component
its name (null if no member has an id); rows that share a doc_id are rows of
their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_words, store, stored
from .prob_minhash import components

SHINGLE, SEED, DISTANCE, BLOCKS = 3, 42, 3, 6
LEAF = 512
#: Words of a text that are hashed at once (bounds a worker's memory).
WORDS_AT_ONCE = 1 << 18
_BYTE = np.uint64(0x0101010101010101)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit set (64 counts, bit 0 first)."""
    counts = np.zeros((8, 8), np.int64)  # [bit in byte, byte]
    for lo in range(0, len(h), 255 * 1024):
        part = h[lo:lo + 255 * 1024]
        cuts = np.arange(0, len(part), 255)  # a byte counts to 255
        for k in range(8):
            sums = np.add.reduceat((part >> np.uint64(k)) & _BYTE, cuts)
            counts[k] += sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.T.reshape(64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text (UTF-8)."""
    words = text.lower().split()  # bytes: ASCII letters and white space alone
    n = len(words)
    if not n:
        return 0
    k = min(shingle, n)
    total, count, digest = n - k + 1, np.zeros(64, np.int64), xxhash.xxh64_digest
    for lo in range(0, total, WORDS_AT_ONCE):
        part = words[lo:lo + WORDS_AT_ONCE + k - 1]
        joined = b" ".join(part)
        size = np.fromiter(map(len, part), np.int64, len(part))
        end = np.cumsum(size + 1) - 1
        first = (end - size)[:len(part) - k + 1].tolist()
        h = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(first, end[k - 1:].tolist(), strict=True)]), ">u8")
        count += _bit_counts(h.astype(np.uint64))
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * count > total)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]):
        forget_words()
        for b in batches:
            fps = np.array([fingerprint(t.as_py() or b"", shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


def split_bits(fixed: int) -> list[int]:
    """The masks that fix, beside ``fixed``, all but ``DISTANCE`` of ``BLOCKS``
    blocks of the free bits."""
    free = [b for b in range(64) if not fixed >> b & 1]
    cuts = [len(free) * i // BLOCKS for i in range(BLOCKS + 1)]
    block = [sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
    return sorted({fixed | sum(c) for c in combinations(block, BLOCKS - DISTANCE)})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_groups(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(member, smallest member of its linked group) for each member of one
    bucket that is not its group's smallest."""
    if len(fp) == 2:  # most buckets
        x, y = sorted(fp.tolist())
        return [(_signed(y), _signed(x))] if (x ^ y).bit_count() <= distance else []
    fp = np.sort(fp)
    close = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
    root = np.arange(len(fp))
    while True:  # the least label among the neighbours, until nothing moves
        new = np.where(close, root[None, :], len(fp)).min(axis=1)
        new = new[new]
        if (new == root).all():
            break
        root = new
    signed = fp.view(np.int64)
    far = np.flatnonzero(root != np.arange(len(fp)))
    return list(zip(signed[far].tolist(), signed[root[far]].tolist(), strict=True))


def _compare(members: DataFrame, distance: int) -> DataFrame:
    """(a, b): linked groups of all buckets; a bucket's rows are neighbours."""

    def run(batches: Iterator[pa.RecordBatch]):
        bucket, held, a, b = None, [], [], []
        for batch in batches:
            mask, value, fp = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((np.diff(mask) != 0) | (np.diff(value) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(fp)], strict=True):
                if hi == lo:
                    continue
                if (mask[lo], value[lo]) != bucket:
                    for x, y in linked_groups(np.concatenate(held).view(np.uint64), distance) if held else ():
                        a.append(x)
                        b.append(y)
                    bucket, held = (mask[lo], value[lo]), []
                held.append(fp[lo:hi].copy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
        for x, y in linked_groups(np.concatenate(held).view(np.uint64), distance) if held else ():
            a.append(x)
            b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return (members.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
            .mapInArrow(run, "a long, b long"))


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): of all distinct fingerprints ``fp`` of ``nodes``, pairs that
    join exactly the fingerprints within ``distance`` bits of each other."""
    if distance > DISTANCE:
        raise ValueError(f"the blocks find pairs of at most {DISTANCE} differing bits")
    first = F.array(*[F.lit(_signed(m)) for m in split_bits(0)])
    members = nodes.select("fp", F.explode(first).alias("mask")).withColumn("value", F.expr("fp & mask"))
    masks, found = split_bits(0), None
    while True:
        # sizes first: most buckets hold one member and go no further
        sizes = members.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        shared = stored(members.join(stored(sizes, "simhash-buckets").small(), ["mask", "value"]), "simhash-members").df
        got = _compare(shared.where(F.col("n") <= LEAF), distance)
        found = got if found is None else found.unionAll(got)
        large = shared.where(F.col("n") > LEAF)
        if large.isEmpty():
            return stored(found.distinct(), "simhash-links").df
        # the masks are made by rule alone: 20, 400 and 8,000 of them
        deeper = {m: split_bits(m) for m in masks}
        masks = sorted({c for cs in deeper.values() for c in cs})
        table = nodes.sparkSession.createDataFrame([(_signed(m), _signed(c)) for m, cs in deeper.items() for c in cs], "mask long, child long")
        members = store(large.select("mask", "fp").join(F.broadcast(table), "mask").select(F.col("child").alias("mask"), "fp").distinct()
                        .withColumn("value", F.expr("fp & mask")), "simhash-split")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits),
    component_id (the smallest doc_id of its component)."""
    rows = stored(fingerprints(docs, key, text), "fingerprints").df
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes").df
    root = components(links(nodes, distance))
    named = nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stored(named, "simhash-roots").df
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    member = stored(named.join(least, "root").select("fp", "component_id"), "simhash-components").small()
    return rows.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
