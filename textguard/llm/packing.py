"""Best-fit packing with swap-based local search.

Method: documents (their ids and an end id) are cut into pieces of at most
``LENGTH`` ids, then placed best-fit decreasing into sequences. Local search
follows on the underfull sequences: a move, a one-for-one or a two-for-one
exchange between two of them is made whenever it raises the sum of squared
fills, so full ones get fuller and empty ones empty out and disappear.

How it is dealt out: pieces that fill a sequence are placed where they are;
the others are dealt by hash into groups of about ``GROUP`` pieces (a few
numbers each, no text), packed per group, and what the groups leave in
sequences that could still take a piece is dealt anew and packed together in a
second round. No group grows with the input.

Edge cases: null and empty texts are a document of the end id alone; rows that
share a doc_id are documents of their own; an empty table packs into nothing.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one, store, to_int
from .tokens import TOKENIZER, encoder

LENGTH = 2048
END_ID = 0
GROUP = 16_384
#: Passes of the local search over the underfull sequences of a group.
PASSES = 6


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, size) of the pieces of a document of ``n`` ids: full pieces,
    the first may be shorter."""
    head = n % length
    starts = ([(0, head)] if head else []) + [(s, length) for s in range(head, n, length)]
    return starts


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID,
           name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc, end = encoder(name), int(end_id).to_bytes(4, "little")
        for b in batches:
            for part, all_ids, off in enc.batches(b, 1):
                doc, num, start, size, crc, ids = [], [], [], [], [], []
                all_raw = all_ids.tobytes()
                for i, (lo, hi) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    raw = all_raw[4 * lo:4 * hi] + end
                    for j, (s, n) in enumerate(cut(hi - lo + 1, length)):
                        cell = raw[4 * s:4 * (s + n)]
                        doc.append(i)
                        num.append(j)
                        start.append(s)
                        size.append(n)
                        crc.append(zlib.crc32(cell))
                        if with_ids:
                            ids.append(np.frombuffer(cell, "<u4").astype(np.int32))
                cols = [part.column(0).take(pa.array(doc, pa.int64())), pa.array(num, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


# --- packing of one group --------------------------------------------------------------

def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. Open bins stand by
    the room they have left; a bit mask finds the tightest that fits."""
    rooms: list[list[int]] = [[] for _ in range(length + 1)]
    mask, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            room, b = length, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        if left:
            rooms[left].append(b)
            mask |= 1 << left
    return bins


def local_search(bins: list[list[int]], sizes: list[int], length: int, passes: int = PASSES) -> list[list[int]]:
    """Moves and exchanges between underfull bins that raise the squared fill.

    For each bin, fullest first, the best way to use its room is taken from
    the emptier bins: an item (move), an item for a smaller one of its own
    (one-for-one) or two items for one (two-for-one). Since the room goes to
    the fuller bin, the sum of squares rises each time; emptied bins go."""
    full = [b for b in bins if sum(sizes[i] for i in b) == length]
    open_bins = [b for b in bins if sum(sizes[i] for i in b) < length]
    for _ in range(passes):
        open_bins = [b for b in open_bins if b]
        fill = [sum(sizes[i] for i in b) for b in open_bins]
        order = sorted(range(len(open_bins)), key=lambda k: (-fill[k], k))
        place = {k: p for p, k in enumerate(order)}
        where: dict[int, list[tuple[int, int, int]]] = {}  # size -> [(place of its bin, bin, item)], emptiest last
        for k in order:
            for i in open_bins[k]:
                where.setdefault(sizes[i], []).append((place[k], k, i))
        keys = sorted(where)
        changed = False

        def take(limit: int, beyond: int, least: int):
            """Largest item of size least < s <= limit in a bin after place ``beyond``."""
            j = bisect_left(keys, limit + 1) - 1
            while j >= 0 and keys[j] > least:
                if where[keys[j]][-1][0] > beyond:
                    return where[keys[j]][-1]
                j -= 1
            return None

        def drop(entry, size):
            where[size].remove(entry)
            if not where[size]:
                del where[size]
                del keys[bisect_left(keys, size)]

        def add(entry, size):
            if size not in where:
                where[size] = []
                insort(keys, size)
            insort(where[size], entry)

        def shift(entry, to):
            p, k, i = entry
            drop(entry, sizes[i])
            open_bins[k].remove(i)
            fill[k] -= sizes[i]
            open_bins[to].append(i)
            fill[to] += sizes[i]
            add((place[to], to, i), sizes[i])

        for p, k in enumerate(order):
            tries = 0
            while open_bins[k] and fill[k] < length and tries < 8:
                tries += 1
                room = length - fill[k]
                got = take(room, p, 0)
                if got:
                    shift(got, k)
                    changed = True
                    continue
                best = None  # (gain, own item, others)
                for i in sorted(open_bins[k], key=lambda i: sizes[i]):
                    a = take(sizes[i] + room, p, sizes[i])
                    if a and (best is None or sizes[a[2]] - sizes[i] > best[0]):
                        best = sizes[a[2]] - sizes[i], i, (a,)
                    a = take(sizes[i] + room - 1, p, 0)
                    if a and (best is None or best[0] < room):
                        drop(a, sizes[a[2]])
                        c = take(sizes[i] + room - sizes[a[2]], p, 0)
                        add(a, sizes[a[2]])
                        if c and sizes[a[2]] + sizes[c[2]] > sizes[i]:
                            gain = sizes[a[2]] + sizes[c[2]] - sizes[i]
                            if (best is None or gain > best[0]) and (c[1] == a[1] or fill[a[1]] - sizes[a[2]] + sizes[i] <= length):
                                best = gain, i, (a, c)
                if best is None:
                    break
                _, i, others = best
                back = others[0][1]  # the own item goes where the first came from
                gone = sum(sizes[o[2]] for o in others if o[1] == back)
                if fill[back] - gone + sizes[i] > length:
                    break
                old = fill[k] ** 2 + sum(fill[b] ** 2 for b in {o[1] for o in others})
                touched = {k, *(o[1] for o in others)}
                for o in others:
                    shift(o, k)
                shift((p, k, i), back)
                changed = True
                if sum(fill[b] ** 2 for b in touched) <= old:
                    break
        if not changed:
            break
    return full + [b for b in open_bins if b]


def pack_group(sizes: list[int], length: int) -> list[list[int]]:
    return local_search(best_fit(sizes, length), sizes, length)


def _pack(rows: DataFrame, length: int, tag: int, keep_all: bool) -> DataFrame:
    """Pack the pieces of each ``deal`` group; ``left`` marks sequences with
    room for the group's smallest piece, to be dealt again."""

    names = [c for c in rows.columns if c != "deal"]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32")])
        sizes, deal = table.column("length").to_pylist(), table.column("deal")[0].as_py()
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        left = np.zeros(len(sizes), bool)
        for b, items in enumerate(pack_group(sizes, length)):
            at = 0
            for i in items:
                seq[i], off[i] = (deal * 2 + tag) << 24 | b, at
                at += sizes[i]
            left[items] = not keep_all and at < length
        out = table.select(names)
        for n, v in (("sequence_id", seq), ("offset", off), ("left", left)):
            out = out.append_column(n, pa.array(v))
        return out

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "deal")
    return rows.groupBy("deal").applyInArrow(run, types + ", sequence_id long, offset long, left boolean")


def pack(rows: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``rows`` (pieces) with sequence_id and offset."""
    rows = store(rows.withColumn("_full", F.col("length") == length), "pieces")
    n = to_int(one(rows.agg(F.count_if(~F.col("_full"))))[0])
    spread = lambda df, k, salt: df.withColumn("deal", F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece", "ids_crc32"), F.lit(k)))
    groups = max(1, math.ceil(n / group))
    first = store(_pack(spread(rows.where("not _full").drop("_full"), groups, 1), length, 0, groups == 1), "packed")
    out = first.where("not left").drop("left")
    if groups > 1:
        again = first.where("left").drop("left", "sequence_id", "offset")
        m = max(1, math.ceil(again.count() / (2 * group)))
        out = out.unionAll(_pack(spread(again, m, 2), length, 1, True).drop("left"))
    # a full piece is a sequence of its own: negative numbers, unique by partition and row
    whole = rows.where("_full").drop("_full").select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return out.unionAll(whole)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID,
                   name: str = TOKENIZER) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, key, text, length, end_id, name), length)


def sequences(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID,
              name: str = TOKENIZER) -> DataFrame:
    """The packed sequences: sequence_id, ids (of all pieces by offset), doc_ids."""
    rows = pack(pieces(docs, key, text, length, end_id, name, with_ids=True), length)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))  # at most ``length`` pieces
    return rows.groupBy("sequence_id").agg(ordered.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))
