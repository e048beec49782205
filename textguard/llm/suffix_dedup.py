"""Suffix-array dedup: long byte strings shared by documents.

Method: the common-prefix interval tree of an enhanced suffix array. Suffixes
are sorted, neighbours' common prefixes (LCP) are scanned with a stack, and
every interval whose LCP is at least ``min_len`` is one repeat with ALL its
occurrences. An interval whose occurrences all have the same byte to the left
is not maximal (the interval one byte to the left says the same and more) and
is dropped; the rest are the maximal repeat groups.

How it is dealt out over Spark:

1. *Blocks.* Rows are packed into blocks of about ``BLOCK`` bytes (a longer
   document is a block of its own), stored once.
2. *Which strings can repeat.* The minimizer (smallest hash of ``k`` bytes) of
   a ``min_len``-byte window depends on the window alone, so equal windows
   have equal minimizers. Each block sends its distinct minimizer hashes to
   hash buckets; a bucket answers, one bit a hash, which occur in two or more
   documents. A hash costs one entry a block, however hot it is.
3. *Suffix arrays by minimizer bucket.* Runs of windows with one repeated
   minimizer are cut out with one byte of left context. Equal strings of a
   block travel once, with the smallest doc_id. A bucket collapses equal
   strings of all blocks, builds the suffix array of the rest, scans its
   interval tree and returns the spans to remove.
4. *Spans* go back to their block, where they are merged and cut out.

A bucket sees at most one entry per distinct string and block, so a passage
held by a third of all documents never lands whole in one task.

The strings of a bucket have at most ``2 * min_len - k`` bytes (84), and so have
the groups. A longer repeat comes out as overlapping groups that cover it
exactly and are not joined; no window of ``min_len`` bytes is lost or added.

Edge cases: null text is empty; a null doc_id is larger than every other; rows
with one doc_id do not remove each other's bytes; texts shorter than
``min_len`` keep all; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_words, mix64, one, pack_arrays, spread_ranges, store, to_int, unpack_arrays

MIN_LEN = 50
ANCHOR = 16
BLOCK = 1 << 20
#: Bytes of text whose minimizers share a bucket, and whose strings share a
#: suffix-array bucket (both set the bucket counts from the input).
TEXT_PER_BUCKET = 16 << 20
STRINGS_PER_BUCKET = 2 << 20
#: Suffixes hashed and sorted at a time.
SLICE = 1 << 16
NO_ID = np.iinfo(np.int64).max


# --- blocks --------------------------------------------------------------------------

def _to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _from_ipc(cell: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(cell) as r:
        return r.read_next_batch()


def _texts(batch: pa.RecordBatch, text: str) -> tuple[bytes, np.ndarray]:
    """All text bytes of a batch and the row offsets into them."""
    cells = [b"" if v is None else v for v in batch.column(text).cast(pa.binary()).to_pylist()]
    return b"".join(cells), np.concatenate(([0], np.cumsum([len(c) for c in cells], dtype=np.int64)))


def _ids(batch: pa.RecordBatch, key: str) -> np.ndarray:
    return np.array([NO_ID if v is None else v for v in batch.column(key).to_pylist()], np.int64)


def pack_blocks(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows of ``docs`` with all columns, packed: (block long, n_bytes long, rows binary)."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 32
        seq, held, size = 0, [], 0

        def out():
            nonlocal seq, held, size
            t = pa.Table.from_batches(held).combine_chunks()
            b = t.to_batches()[0]
            row = pa.RecordBatch.from_pydict({"block": pa.array([base + seq], pa.int64()), "n_bytes": pa.array([size], pa.int64()),
                                              "rows": pa.array([_to_ipc(b)], pa.binary())})
            seq, held, size = seq + 1, [], 0
            return row

        for b in batches:
            lens = [0 if v is None else v for v in pa.compute.binary_length(b.column(text).cast(pa.binary())).to_pylist()]
            start = 0
            for i, n in enumerate(lens):
                if size and size + n > block:
                    if i > start:
                        held.append(b.slice(start, i - start))
                    start = i
                    yield out()
                size += n
            if start < b.num_rows:
                held.append(b.slice(start))
                if size >= block:
                    yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, "block long, n_bytes long, rows binary")


# --- minimizers ----------------------------------------------------------------------

def _gram_hashes(b: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every ``k``-byte string of ``b`` (k a power of two)."""
    h, n = b.astype(np.uint64) + np.uint64(0x9E37), 1
    while n < k:
        m = len(h) - n
        x = h[:m] * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x += h[n:n + m]
        h, n = x, 2 * n
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    cur, n = h, 1
    while 2 * n <= w:
        cur = np.minimum(cur[:-n], cur[n:])
        n *= 2
    if n < w:
        m = len(h) - w + 1
        cur = np.minimum(cur[:m], cur[w - n:w - n + m])
    return cur


def minimizer_runs(data: bytes, offsets: np.ndarray, min_len: int, k: int, chunk: int = 1 << 20):
    """Maximal runs of windows with one minimizer, at most ``min_len - k + 1``
    windows long: (row, first window, windows, minimizer hash). Windows never
    cross rows. Long texts are worked through in overlapping chunks."""
    b, w = np.frombuffer(data, np.uint8), min_len - k + 1
    starts, counts, hashes = [], [], []
    lo, end = 0, len(b)
    while lo + min_len <= end:
        hi = min(end, lo + chunk + min_len - 1)
        m = _sliding_min(_gram_hashes(b[lo:hi], k), w)
        new = np.empty(len(m), bool)
        new[0] = True
        np.not_equal(m[1:], m[:-1], out=new[1:])
        inner = offsets[(offsets > lo) & (offsets < lo + len(m))] - lo
        new[inner] = True
        at = np.flatnonzero(new)
        starts.append(at + lo)
        counts.append(np.diff(np.concatenate((at, [len(m)]))))
        hashes.append(m[at])
        lo += len(m)
    if not starts:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, np.uint64)
    s, n, h = np.concatenate(starts), np.concatenate(counts), np.concatenate(hashes)
    row = np.searchsorted(offsets, s, side="right") - 1
    n = np.minimum(n, offsets[row + 1] - min_len + 1 - s)  # windows that end in their row
    ok = n > 0
    s, n, h, row = s[ok], n[ok], h[ok], row[ok]
    if len(n) and n.max() > w:  # periodic texts: equal minima further apart than a window
        parts = -(-n // w)
        i = np.repeat(np.arange(len(n)), parts)
        j = spread_ranges(np.zeros(len(n)), parts)
        s, n, h, row = s[i] + j * w, np.minimum(w, n[i] - j * w), h[i], row[i]
    return row, s, n, mix64(h)


# --- step 2: which minimizers occur in two documents -----------------------------------

def _bucket_sets(runs, ids: np.ndarray, n_buckets: int):
    """Per bucket: its sorted distinct hashes in this block and whether two
    documents of the block hold each. Yields (bucket, hashes, held twice)."""
    row, _, _, h = runs
    if not len(h):
        return
    order = np.lexsort((ids[row], h))
    hs, d = h[order], ids[row][order]
    first = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
    twice = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    u = hs[first]
    bucket = (u % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
    for part in np.split(order, cut[1:]):
        yield int(bucket[part[0]]), u[part], twice[part]


def _anchor_rows(text: str, key: str, min_len: int, k: int, n_buckets: int):
    def run(batches):
        forget_words()
        for b in batches:
            for blk, cell in zip(b.column("block").to_pylist(), b.column("rows").to_pylist(), strict=True):
                rows = _from_ipc(cell)
                data, off = _texts(rows, text)
                got = [(g, pack_arrays((u // np.uint64(n_buckets) >> np.uint64(8)).astype(np.uint32), np.packbits(t)))
                       for g, u, t in _bucket_sets(minimizer_runs(data, off, min_len, k), _ids(rows, key), n_buckets)]
                if got:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([g for g, _ in got], pa.int64()),
                                                      "block": pa.array([blk] * len(got), pa.int64()),
                                                      "cell": pa.array([c for _, c in got], pa.binary())})
    return run


def _repeated(table: pa.Table) -> pa.Table:
    """One bucket: a bit for each hash of each block, set if two documents hold it."""
    cells = [unpack_arrays(c) for c in table.column("cell").to_pylist()]
    sizes = [len(c[0]) for c in cells]
    h = np.concatenate([c[0] for c in cells])
    twice = np.concatenate([np.unpackbits(c[1], count=n) for c, n in zip(cells, sizes, strict=True)]).astype(bool)
    _, inv, count = np.unique(h, return_inverse=True, return_counts=True)
    many = count > 1
    np.logical_or.at(many, inv[twice], True)
    bits, at, out = many[inv], 0, []
    for n in sizes:
        out.append(np.packbits(bits[at:at + n]).tobytes() if bits[at:at + n].any() else None)
        at += n
    keep = [i for i, c in enumerate(out) if c is not None]
    return pa.table({"block": table.column("block").take(pa.array(keep, pa.int64())), "bucket": table.column("bucket").take(pa.array(keep, pa.int64())),
                     "bits": pa.array([out[i] for i in keep], pa.binary())})


# --- step 3: strings to suffix-array buckets ------------------------------------------

def _string_rows(text: str, key: str, min_len: int, k: int, n1: int, n2: int, groups: bool):
    """For each block with repeated minimizers: the strings to compare, by
    bucket (kind 0), and the spans that the block alone decides (kind 1)."""

    def strings(blk, rows, bits):
        data, off = _texts(rows, text)
        ids = _ids(rows, key)
        runs = minimizer_runs(data, off, min_len, k)
        hot = [u[np.unpackbits(np.frombuffer(bits[g], np.uint8), count=len(u)).astype(bool)]
               for g, u, _ in _bucket_sets(runs, ids, n1) if g in bits]
        row, s, n, h = runs
        on = np.isin(h, np.concatenate(hot)) if hot else np.zeros(len(h), bool)
        row, s, n, h = row[on], s[on], n[on], h[on]
        if not len(s):
            return
        left = np.where(s > off[row], 1, 0)  # a byte to the left in the same row
        a, e = s - left, s + n + min_len - 1
        seen: dict[bytes, int] = {}
        cls = np.empty(len(s), np.int64)
        first = []
        for i, (x, y, f) in enumerate(zip(a.tolist(), e.tolist(), left.tolist(), strict=True)):
            c = seen.setdefault((b"l" if f else b"s") + data[x:y], len(first))
            if c == len(first):
                first.append(i)
            cls[i] = c
        first = np.array(first)
        d = ids[row]
        least = np.full(len(first), NO_ID, np.int64)
        np.minimum.at(least, cls, d)
        own = d == least[cls]
        start = s - off[row]
        if not own.all():  # an equal string stands in an earlier document of this block
            o = ~own
            yield 1, 0, pack_arrays(row[o], start[o], (n + min_len - 1)[o])
        # strings by bucket, each with its places in the earliest document (or all, for groups)
        show = np.ones(len(own), bool) if groups else own
        place_order = np.flatnonzero(show)[np.argsort(cls[show], kind="stable")]
        n_places = np.bincount(cls[place_order], minlength=len(first))
        place_at = np.cumsum(n_places) - n_places
        bucket = (mix64(h[first]) % np.uint64(n2)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
        buf = np.frombuffer(data, np.uint8)
        for part in np.split(order, cut[1:]):
            i = first[part]
            p = place_order[spread_ranges(place_at[part], n_places[part])]
            yield 0, int(bucket[part[0]]), pack_arrays(
                left[i].astype(np.uint8), (e[i] - a[i]).astype(np.int32), buf[spread_ranges(a[i], e[i] - a[i])], least[part],
                n_places[part].astype(np.int32), row[p].astype(np.int32), start[p], d[p])

    def run(batches):
        forget_words()
        for b in batches:
            for blk, cell, marks in zip(b.column("block").to_pylist(), b.column("rows").to_pylist(), b.column("marks").to_pylist(), strict=True):
                got = list(strings(blk, _from_ipc(cell), {m["bucket"]: m["bits"] for m in marks}))
                if got:
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([g[0] for g in got], pa.int32()), "bucket": pa.array([g[1] for g in got], pa.int64()),
                                                      "block": pa.array([blk] * len(got), pa.int64()), "cell": pa.array([g[2] for g in got], pa.binary())})
    return run


def suffix_array(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes ``data[start:start + length]`` (none longer than
    ``width``) and the LCP of each with the one before it (0 for the first)."""
    width += -width % 8
    cols = np.arange(width, dtype=np.int64)
    m = data[np.minimum(starts[:, None] + cols, len(data) - 1)]
    m[cols >= lengths[:, None]] = 0
    words = m.view(">u8")
    order = np.lexsort((lengths, *(words[:, j] for j in range(words.shape[1] - 1, -1, -1))))
    m, n = m[order], lengths[order]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = m[1:] != m[:-1]
        far = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[1:] = np.minimum(far, np.minimum(n[1:], n[:-1]))
    return order, lcp


def interval_tree(lcp: np.ndarray, left: np.ndarray, least_lcp: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stack scan of an LCP array: the intervals ``[lo, hi]`` of LCP ``depth``
    >= ``least_lcp`` whose suffixes differ in their left byte. ``left``: the
    byte before each suffix, or 256 at the start of a string (differs from
    all, itself included)."""
    lo_out, hi_out, depth_out = [], [], []
    stack: list[list[int]] = []  # [depth, lo, left byte or -1 once two differ]
    codes = left.tolist()
    codes = [-1 if c > 255 else c for c in codes]
    last = len(codes)
    for i, d in enumerate([*lcp.tolist(), 0]):
        if i == 0:
            continue
        if d < least_lcp:
            d = 0
        lo, c = i - 1, codes[i - 1]
        while stack and stack[-1][0] > d:
            depth, start, sc = stack.pop()
            c = c if c == sc else -1
            if c < 0:
                lo_out.append(start)
                hi_out.append(i - 1)
                depth_out.append(depth)
            lo = start
        if d:
            if stack and stack[-1][0] == d:
                if stack[-1][2] != c:
                    stack[-1][2] = -1
            else:
                stack.append([d, lo, c])
        if i == last:
            break
    return np.array(lo_out, np.int64), np.array(hi_out, np.int64), np.array(depth_out, np.int64)


def _window_hash(b: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every ``n``-byte window."""
    h, k = b.astype(np.uint64) + np.uint64(0x1F), 1
    parts = None
    done = 0
    while True:
        if n & k:
            parts = h if parts is None else parts[:len(parts) - k] * np.uint64(0x9E3779B97F4A7C15) + (lambda t: t ^ (t >> np.uint64(29)))(h[done:done + len(parts) - k] * np.uint64(0xD6E8FEB86659FD93))
            done += k
        if 2 * k > n:
            return parts
        m = len(h) - k
        x = h[:m] * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        h, k = x * np.uint64(0x94D049BB133111EB) + h[k:k + m], 2 * k


def _bucket_groups(cells: list[list[np.ndarray]], min_len: int):
    """Enhanced suffix array of one bucket.

    Returns per string: its class of equal strings, per class the smallest
    doc_id, and the maximal repeat groups as (group depth, class, offset)
    lists, with each group's smallest doc_id."""
    left = np.concatenate([c[0] for c in cells])
    length = np.concatenate([c[1] for c in cells]).astype(np.int64)
    data = np.concatenate([c[2] for c in cells])
    least = np.concatenate([c[3] for c in cells])
    start = np.cumsum(length) - length
    raw = data.tobytes()
    seen: dict[bytes, int] = {}
    cls = np.empty(len(start), np.int64)
    first = []
    for i, (x, n, f) in enumerate(zip(start.tolist(), length.tolist(), left.tolist(), strict=True)):
        c = seen.setdefault((b"l" if f else b"s") + raw[x:x + n], len(first))
        if c == len(first):
            first.append(i)
        cls[i] = c
    del seen
    first = np.array(first, np.int64)
    cmin = np.full(len(first), NO_ID, np.int64)
    np.minimum.at(cmin, cls, least)
    # windows of the distinct strings whose bytes stand at two places at least
    cs, cl, cf = start[first], length[first], left[first].astype(np.int64)
    n_win = cl - cf - min_len + 1
    owner = np.repeat(np.arange(len(first)), n_win)
    pos = spread_ranges(cs + cf, n_win)
    wh = np.empty(len(pos), np.uint64)
    for at in range(0, len(pos), SLICE):
        p = pos[at:at + SLICE]
        wh[at:at + SLICE] = _window_hash(data[p[0]:p[-1] + min_len], min_len)[p - p[0]]
    order = np.argsort(wh, kind="stable")
    wh, owner, pos = wh[order], owner[order], pos[order]
    new = np.concatenate(([True], wh[1:] != wh[:-1])) if len(wh) else np.empty(0, bool)
    alone = new & np.concatenate((new[1:], [True])) if len(wh) else new
    wh, owner, pos = wh[~alone], owner[~alone], pos[~alone]
    # an interval of LCP >= min_len lies within one window hash: the suffix
    # array is built in slices of whole hashes, which bounds the memory
    ends = np.concatenate((np.flatnonzero(wh[1:] != wh[:-1]) + 1, [len(wh)])) if len(wh) else np.empty(0, np.int64)
    e = np.empty(0, np.int64)
    group, member_of, offset, depths, gmins = [e], [e], [e], [e], [e]
    n_groups = at = 0
    while at < len(wh):
        stop = int(ends[min(np.searchsorted(ends, at + SLICE), len(ends) - 1)])
        own, p = owner[at:stop], pos[at:stop]
        at = stop
        tail = (cs + cl)[own] - p
        order, lcp = suffix_array(data, p, tail, int(tail.max()))
        own, p = own[order], p[order]
        body = cs[own] + cf[own]
        lo, hi, depth = interval_tree(lcp, np.where(p > body, data[p - 1].astype(np.int64), 256), min_len)
        if not len(lo):
            continue
        size = hi - lo + 1
        member = spread_ranges(lo, size)
        group.append(n_groups + np.repeat(np.arange(len(lo)), size))
        member_of.append(own[member])
        offset.append((p - body)[member])
        depths.append(depth)
        gmins.append(np.minimum.reduceat(cmin[own[member]], np.cumsum(size) - size))
        n_groups += len(lo)
    return cls, cmin, tuple(np.concatenate(x) for x in (group, member_of, offset, depths, gmins))


def _bucket_spans(min_len: int):
    def run(table: pa.Table) -> pa.Table:
        forget_words()
        cells = [unpack_arrays(c) for c in table.column("cell").to_pylist()]
        blocks = table.column("block").to_numpy()
        cls, cmin, (group, owner, offset, depth, gmin) = _bucket_groups(cells, min_len)
        n_str = np.array([len(c[0]) for c in cells])
        blk = np.repeat(np.arange(len(cells)), n_str)
        left = np.concatenate([c[0] for c in cells]).astype(np.int64)
        body = np.concatenate([c[1] for c in cells]).astype(np.int64) - left
        least = np.concatenate([c[3] for c in cells])
        n_places = np.concatenate([c[4] for c in cells]).astype(np.int64)
        place_at = np.cumsum(n_places) - n_places
        prow, pstart = np.concatenate([c[5] for c in cells]).astype(np.int64), np.concatenate([c[6] for c in cells])
        # (string, offset, length) to remove: whole strings equal to an earlier one ...
        late = np.flatnonzero(least > cmin[cls])
        what = [(late, np.zeros(len(late), np.int64), body[late])]
        # ... and, of the earliest ones, what groups share with an earlier document
        hit = cmin[owner] > gmin[group]
        if hit.any():
            o, off, n = owner[hit], offset[hit], depth[group[hit]]
            early = np.flatnonzero(least == cmin[cls])
            early = early[np.argsort(cls[early], kind="stable")]
            per = np.bincount(cls[early], minlength=len(cmin))
            at = np.cumsum(per) - per
            what.append((early[spread_ranges(at[o], per[o])], np.repeat(off, per[o]), np.repeat(n, per[o])))
        string, off, n = (np.concatenate(x) for x in zip(*what, strict=True))
        p = spread_ranges(place_at[string], n_places[string])
        rep = n_places[string]
        b, r, s, m = np.repeat(blk[string], rep), prow[p], pstart[p] + np.repeat(off, rep), np.repeat(n, rep)
        order = np.argsort(b, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(b[order]) != 0))) if len(b) else []
        parts = np.split(order, cut[1:]) if len(b) else []
        return pa.table({"block": pa.array([int(blocks[b[q[0]]]) for q in parts], pa.int64()),
                         "cell": pa.array([pack_arrays(*merge_spans(r[q], s[q], m[q])) for q in parts], pa.binary())})
    return run


def merge_spans(row: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans by row, as disjoint spans that do not touch."""
    if not len(row):
        return row, start, length
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], (start + length)[order]
    base = (row - row.min()) * (int(end.max()) + 2)  # rows far apart on one line
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate(([True], (base + start)[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(row)])) - 1
    s = start[at]
    return row[at], s, reach[last] - base[at] - s


# --- the operator ----------------------------------------------------------------------

def _candidate_strings(docs: DataFrame, key: str, text: str, min_len: int, k: int, groups: bool) -> tuple[DataFrame, DataFrame, int]:
    """Stored blocks, stored strings (kind 0) and spans (kind 1), bucket count."""
    blocks = store(pack_blocks(docs, text), "blocks")
    total = to_int(one(blocks.agg(F.sum("n_bytes")))[0])
    n1 = max(1, math.ceil(total / TEXT_PER_BUCKET))
    anchors = blocks.select("block", "rows").mapInArrow(_anchor_rows(text, key, min_len, k, n1), "bucket long, block long, cell binary")
    marks = anchors.groupBy("bucket").applyInArrow(_repeated, "block long, bucket long, bits binary")
    by_block = store(marks, "marks").groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))
    n2 = max(1, math.ceil(total / STRINGS_PER_BUCKET))
    strings = (blocks.join(by_block, "block").select("block", "rows", "marks")
               .mapInArrow(_string_rows(text, key, min_len, k, n1, n2, groups), "kind int, bucket long, block long, cell binary"))
    return blocks, store(strings, "strings"), n2


def repeat_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", min_len: int = MIN_LEN, anchor: int = ANCHOR) -> DataFrame:
    """The repeat groups, one row per occurrence: ``group`` (id), ``length``
    bytes (at most ``2 * min_len - anchor``: a longer repeat is several
    overlapping groups), ``n_places``, ``doc_id``, ``start``. Strings that
    stand once, or only in one place, give no group."""

    def run(table: pa.Table) -> pa.Table:
        cells = [unpack_arrays(c) for c in table.column("cell").to_pylist()]
        cls, cmin, (group, owner, offset, depth, _) = _bucket_groups(cells, min_len)
        n_places = np.concatenate([c[4] for c in cells]).astype(np.int64)
        place_at = np.cumsum(n_places) - n_places
        pstart, pid = np.concatenate([c[6] for c in cells]), np.concatenate([c[7] for c in cells])
        left = np.concatenate([c[0] for c in cells]).astype(np.int64)
        body = np.concatenate([c[1] for c in cells]).astype(np.int64) - left
        order = np.argsort(cls, kind="stable")
        per = np.bincount(cls, minlength=len(cmin))
        at = np.cumsum(per) - per
        places = np.bincount(cls, weights=n_places, minlength=len(cmin)).astype(np.int64)
        # whole strings that stand in several places are groups of their own, besides the tree's
        solo = np.flatnonzero(places > 1)
        g = np.concatenate((group, len(depth) + np.arange(len(solo))))
        o, off = np.concatenate((owner, solo)), np.concatenate((offset, np.zeros(len(solo), np.int64)))
        first = order[at]
        deep = np.concatenate((depth, body[first[solo]]))
        strings = order[spread_ranges(at[o], per[o])]
        g2, off2 = np.repeat(g, per[o]), np.repeat(off, per[o])
        p = spread_ranges(place_at[strings], n_places[strings])
        g3, off3 = np.repeat(g2, n_places[strings]), np.repeat(off2, n_places[strings])
        n = np.bincount(g3, minlength=len(deep))
        name = int(table.column("bucket")[0].as_py())
        return pa.table({"group": pa.array([f"{name}-{x}" for x in g3.tolist()], pa.string()), "length": pa.array(deep[g3], pa.int64()),
                         "n_places": pa.array(n[g3], pa.int64()), "doc_id": pa.array(pid[p], pa.int64(), mask=pid[p] == NO_ID),
                         "start": pa.array(pstart[p] + off3, pa.int64())})

    _, strings, _ = _candidate_strings(docs, key, text, min_len, anchor, True)
    return (strings.where("kind = 0").groupBy("bucket")
            .applyInArrow(run, "group string, length long, n_places long, doc_id long, start long"))


def removal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_len: int = MIN_LEN,
                  anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """(blocks, spans by block): the bytes that stand in an earlier document."""
    blocks, strings, _ = _candidate_strings(docs, key, text, min_len, anchor, False)
    spans = (strings.where("kind = 0").groupBy("bucket").applyInArrow(_bucket_spans(min_len), "block long, cell binary")
             .unionAll(strings.where("kind = 1").select("block", "cell")))
    return blocks, store(spans, "spans").groupBy("block").agg(F.collect_list("cell").alias("cells"))


def _cut(rows: pa.RecordBatch, cells: list[bytes] | None, text: str, whole: bool = False):
    """Per row: original bytes, kept bytes, spans. ``whole``: code points that
    a span cuts in two stay."""
    spans: dict[int, list[tuple[int, int]]] = {}
    if cells:
        parts = [unpack_arrays(c) for c in cells]
        for r, s, n in zip(*(a.tolist() for a in merge_spans(*(np.concatenate([p[j] for p in parts]).astype(np.int64) for j in range(3)))), strict=True):
            spans.setdefault(r, []).append((s, s + n))
    for i, v in enumerate(rows.column(text).cast(pa.binary()).to_pylist()):
        v = v or b""
        at, kept = 0, []
        for s, e in spans.get(i, ()):
            while whole and s < e and v[s] & 0xC0 == 0x80:
                s += 1
            while whole and s < e < len(v) and v[e] & 0xC0 == 0x80:
                e -= 1
            kept.append(v[at:s])
            at = e
        kept.append(v[at:])
        yield v, b"".join(kept), spans.get(i, [])


def dedup_report(docs: DataFrame, key: str = "doc_id", text: str = "text", min_len: int = MIN_LEN) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256`` and ``spans`` (start, end), the maximal removed runs."""
    blocks, spans = removal_spans(docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text)), key, text, min_len)

    def run(batches):
        for b in batches:
            for cell, cells in zip(b.column("rows").to_pylist(), b.column("cells").to_pylist(), strict=True):
                rows = _from_ipc(cell)
                got = list(_cut(rows, cells, text))
                yield pa.RecordBatch.from_arrays([
                    rows.column(key).cast(pa.int64()), pa.array([len(v) for v, _, _ in got], pa.int64()),
                    pa.array([len(v) - len(k) for v, k, _ in got], pa.int64()), pa.array([len(s) for _, _, s in got], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for _, k, _ in got], pa.string()),
                    pa.array([[{"start": x, "end": y} for x, y in s] for _, _, s in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return (blocks.join(spans, "block", "left").select("rows", "cells")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_len: int = MIN_LEN, length: str | None = None) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; all other columns
    as they were, but ``length`` (a column of code-point counts), if named, is
    set anew. A code point of which only a part repeats stays whole. Texts with nothing removed,
    null included, stay as they are."""
    blocks, spans = removal_spans(docs, key, text, min_len)
    names = docs.columns

    def run(batches):
        for b in batches:
            for cell, cells in zip(b.column("rows").to_pylist(), b.column("cells").to_pylist(), strict=True):
                rows = _from_ipc(cell)
                if cells:
                    old = rows.column(text).to_pylist()
                    new = [o if not s else k.decode() for o, (_, k, s) in zip(old, _cut(rows, cells, text, True), strict=True)]
                    cols = {n: rows.column(n) for n in names}
                    cols[text] = pa.array(new, rows.schema.field(text).type)
                    if length:
                        typ = rows.schema.field(length).type
                        cols[length] = pa.array([x if n == o else len(n) for x, o, n in zip(rows.column(length).to_pylist(), old, new, strict=True)], typ)
                    rows = pa.RecordBatch.from_arrays([cols[n] for n in names], schema=rows.schema)
                yield rows

    return blocks.join(spans, "block", "left").select("rows", "cells").mapInArrow(run, docs.schema)
