"""Token-ID files with Re-Pair grammar compression.

Method: the ids of all documents, in ascending doc_id order and each followed
by the end id, are cut into shards at document boundaries. In a shard the most
frequent id pairs are replaced by nonterminals, again and again: each round
counts the adjacent pairs inside documents and replaces up to ``PAIRS`` of
those that stand ``MIN_COUNT`` times or more, left to right without overlap,
until no pair stands that often.
A shard stores the rules, the expansion length of every nonterminal and the
reduced sequence with the place where each document begins, so any document
(or any range of its ids) is decoded without the rest of the shard.

File format: a folder of Parquet files, one row per shard in ascending order:

    shard long          position in the order (gapless, from 0)
    n_docs, n_ids long  documents and ids of the shard, end ids included
    start long          ids of all shards before it
    base int            number of plain ids; base + r is the symbol of rule r
    doc_ids binary      int64 each (null ids: a bit mask follows in doc_nulls)
    doc_nulls binary    one bit a document
    doc_ids_n binary    uint32: ids of each document, end id included
    doc_at binary       uint64: where each document begins in ``sequence``
    rules binary        uint32 pairs (left, right), symbols below their own
    lengths binary      uint32: ids in the expansion of each rule
    sequence binary     uint32 symbols

Rows are range-partitioned by doc_id, so no task holds more than a range of
the table; a shard holds about ``SHARD_IDS`` ids (one longer document is a
shard of its own).

Edge cases: null and empty texts are the end id alone; a null doc_id sorts
first; rows with one doc_id keep their texts' order; an empty table writes no shard.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import shuffle_cleanup, spread_ranges, stored
from .tokens import TOKENIZER, encoder

END_ID = 2
SHARD_IDS = 1 << 20
ROUNDS, PAIRS, MIN_COUNT = None, 8192, 16
_BITS = 18


# --- the grammar -----------------------------------------------------------------------

def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Table slot of each pair of symbols (uint32)."""
    return (left * np.uint32(0x9E3779B1) + (right ^ np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - _BITS)


def compress(ids: np.ndarray, at: np.ndarray, base: int, rounds: int | None = ROUNDS, pairs: int = PAIRS,
             min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, document starts in it, rules): Re-Pair in rounds, as many as
    it takes (or ``rounds``). ``at``: where each document begins; no rule
    reaches over a document's end."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)  # the last symbol of a document opens no pair
    if len(seq):
        last[np.concatenate((at[1:], [len(seq)])) - 1] = True
    rules: list[np.ndarray] = []
    symbols = base
    live = ~last  # symbols whose pair may stand often enough: pairs of old symbols only get rarer
    done = 0
    while rounds is None or done < rounds:
        done += 1
        at_ = np.flatnonzero(live)
        if not len(at_):
            break
        # exact counts are needed only of pairs in table slots that reach the minimum
        left, right = seq[live], seq[1:][live[:-1]]  # the last symbol of all opens no pair
        slot = _slots(left, right)
        heavy = (np.bincount(slot, minlength=1 << _BITS) >= min_count)[slot]
        at_, slot = at_[heavy], slot[heavy]
        key = (left[heavy].astype(np.uint64) << np.uint64(32)) | right[heavy]
        some = np.sort(key)
        if not len(some):
            break
        new = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
        count = np.diff(np.concatenate((new, [len(some)])))
        pair = some[new]
        ok = count >= min_count
        pair, count = pair[ok], count[ok]
        if not len(pair):
            break
        # slots without a pair that stands often enough are settled
        slot_live = np.zeros(1 << _BITS, bool)
        slot_live[_slots((pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32))] = True
        still = at_[slot_live[slot]]
        order = np.lexsort((pair, -count))[:pairs]
        pair = pair[order]
        # one pair a table slot, the most frequent (the others wait for the next round)
        place = _slots((pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32))
        _, first = np.unique(place, return_index=True)
        first.sort()
        pair, place = pair[first], place[first]
        table = np.full(1 << _BITS, -1, np.int32)
        table[place] = np.arange(len(pair), dtype=np.int32)
        rule = table[slot]
        hit = np.flatnonzero(rule >= 0)
        hit = hit[pair[rule[hit]] == key[hit]]
        pos, rule = at_[hit], rule[hit]
        # neighbours overlap: of a run of hits every second one counts
        runs = np.flatnonzero(np.concatenate(([True], np.diff(pos) > 1)))
        every = (np.arange(len(pos)) - np.repeat(runs, np.diff(np.concatenate((runs, [len(pos)]))))) & 1 == 0
        pos = pos[every]
        seq[pos] = symbols + rule[every]
        last[pos] = last[pos + 1]
        live = np.zeros(len(seq), bool)
        live[still] = True
        keep = np.ones(len(seq), bool)
        keep[pos + 1] = False
        seq, last, live = seq[keep], last[keep], live[keep]
        # the new symbol's pair, and that of the symbol before it
        new = pos - np.arange(len(pos))
        live[new] = True
        live[new[new > 0] - 1] = True
        live &= ~last
        rules.append(np.stack(((pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32)), axis=1))
        symbols += len(pair)
    ends = np.flatnonzero(last) + 1
    return seq, np.concatenate((np.zeros(min(1, len(ends)), np.int64), ends[:-1])), np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Ids in the expansion of each rule (rules refer to earlier symbols only)."""
    n = np.ones(len(rules), np.int64)
    todo = np.arange(len(rules))
    size = lambda s: np.where(s < base, 1, n[np.maximum(s.astype(np.int64) - base, 0)])
    while len(todo):  # as often as rules nest
        new = size(rules[todo, 0]) + size(rules[todo, 1])
        changed = new != n[todo]
        n[todo] = new
        if not changed.any():
            break
    return n.astype(np.uint32)


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids of a stretch of symbols."""
    while len(seq):
        non = seq >= base
        if not non.any():
            break
        width = 1 + non.astype(np.int64)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.uint32)
        out[at[~non]] = seq[~non]
        r = rules[seq[non] - np.uint32(base)]
        out[at[non]], out[at[non] + 1] = r[:, 0], r[:, 1]
        seq = out
    return seq.astype(np.uint32)


def expand_all(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The ids of a whole shard: every rule is expanded once, then copied."""
    flat = np.concatenate((np.arange(base, dtype=np.uint32), expand(np.arange(base, base + len(rules), dtype=np.uint32), rules, base)))
    n = np.concatenate((np.ones(base, np.int64), lengths.astype(np.int64)))
    start = np.cumsum(n) - n
    return flat[spread_ranges(start[seq], n[seq])]


def decode_range(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int, lo: int, hi: int) -> np.ndarray:
    """Ids ``lo`` to ``hi`` of a document's symbols: the expansion lengths
    tell which symbols hold them, only those are expanded."""
    n = np.where(seq < base, 1, lengths[np.maximum(seq.astype(np.int64) - base, 0)] if len(lengths) else 1).astype(np.int64)
    ends = np.cumsum(n)
    a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi, side="left") + 1
    skip = int(ends[a - 1]) if a else 0
    return expand(seq[a:b], rules, base)[lo - skip:hi - skip]


# --- writing ---------------------------------------------------------------------------

_SCHEMA = ("part long, n_docs long, n_ids long, base int, doc_ids binary, doc_nulls binary, doc_ids_n binary, doc_at binary, "
           "rules binary, lengths binary, sequence binary")


def write(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, name: str = TOKENIZER,
          shard_ids: int = SHARD_IDS) -> None:
    """Write the token files of ``docs`` to the folder ``path``."""

    def run(batches):
        from pyspark import TaskContext
        enc, end = encoder(name), int(end_id).to_bytes(4, "little")
        base = enc.tokenizer.get_vocab_size()
        part, seq, cells, ids = TaskContext.get().partitionId() << 32, 0, [], []

        def shard():
            raw = np.frombuffer(b"".join(cells), "<u4")
            n = np.array([len(c) // 4 for c in cells], np.int64)
            out, at, rules = compress(raw, np.cumsum(n) - n, base)
            null = np.array([i is None for i in ids])
            row = [part + seq, len(ids), len(raw), base, np.array([0 if i is None else i for i in ids], "<i8").tobytes(), np.packbits(null).tobytes(),
                   n.astype("<u4").tobytes(), at.astype("<u8").tobytes(), rules.astype("<u4").tobytes(),
                   expansion_lengths(rules, base).astype("<u4").tobytes(), out.astype("<u4").tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                                              names=["part", "n_docs", "n_ids", "base", "doc_ids", "doc_nulls", "doc_ids_n", "doc_at", "rules", "lengths", "sequence"])

        size = 0
        for b in batches:
            for rows, all_ids, off in enc.batches(b, 1):
                raw = all_ids.tobytes()
                for i, lo, hi in zip(rows.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    if cells and size + hi - lo + 1 > shard_ids:
                        yield shard()
                        seq, size, cells, ids = seq + 1, 0, [], []
                    cells.append(raw[4 * lo:4 * hi] + end)
                    ids.append(i)
                    size += hi - lo + 1
        if cells:
            yield shard()

    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _SCHEMA)
    with shuffle_cleanup(spark):
        shards.write.mode("errorifexists").option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with their place in the order and the ids before them (one
    row of numbers per shard passes the window, the cells do not)."""
    files = spark.read.parquet(path)
    order = W.orderBy("part")
    heads = files.select("part", "n_ids").withColumn("shard", (F.row_number().over(order) - 1).cast("long")).withColumn("start", F.sum("n_ids").over(order) - F.col("n_ids"))
    return files.join(stored(heads.select("part", "shard", "start"), "heads").small(), "part")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document, decoded from the files: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 (and ids)."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                n = np.frombuffer(r["doc_ids_n"], "<u4").astype(np.int64)
                rules = np.frombuffer(r["rules"], "<u4").reshape(-1, 2)
                ids = expand_all(np.frombuffer(r["sequence"], "<u4"), rules, np.frombuffer(r["lengths"], "<u4"), r["base"])
                doc = np.frombuffer(r["doc_ids"], "<i8")
                null = np.unpackbits(np.frombuffer(r["doc_nulls"], np.uint8), count=len(doc)).astype(bool)
                at = np.cumsum(n) - n
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                cols = [pa.array(doc, pa.int64(), mask=null), pa.array(at + r["start"], pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate((at, [len(ids)])), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return read_shards(spark, path).drop("part", "n_docs", "shard").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int, lo: int = 0, hi: int | None = None) -> list[list[int]]:
    """Ids ``lo`` to ``hi`` of the documents with this id: only their symbols
    are expanded (one document's ids come to the driver)."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                doc, at = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_at"], "<u8").astype(np.int64)
                null = np.unpackbits(np.frombuffer(r["doc_nulls"], np.uint8), count=len(doc)).astype(bool)
                n, seq = np.frombuffer(r["doc_ids_n"], "<u4"), np.frombuffer(r["sequence"], "<u4")
                rules, lengths = np.frombuffer(r["rules"], "<u4").reshape(-1, 2), np.frombuffer(r["lengths"], "<u4")
                ends = np.concatenate((at[1:], [len(seq)]))
                for j in np.flatnonzero((doc == doc_id) & ~null):
                    got = decode_range(seq[at[j]:ends[j]], rules, lengths, r["base"], lo, min(hi if hi is not None else int(n[j]), int(n[j])))
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([got.astype(np.int32)], pa.list_(pa.int32()))})

    return [list(r.ids) for r in spark.read.parquet(path).mapInArrow(run, "ids array<int>").collect()]


def write_and_read(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = TOKENIZER) -> DataFrame:
    """Write the files to the shared folder and read them back."""
    spark = docs.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "llm", f"tokens-{uuid.uuid4().hex}")
    write(docs, path, key, text, END_ID, name)
    return read(spark, path)
