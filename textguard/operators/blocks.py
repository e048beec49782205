"""Texts as blocks of word codes, for models with very many entries.

A model of a corpus (word weights, counts of word runs) grows with the corpus,
so neither side of the lookup fits a broadcast, and a row per word of each text
moves many times the text. Here a task packs its texts into blocks: the block's
distinct words, and per text the codes of its words. A word or a run of words is
looked up once per block, the answers go back to the block, and the sums of a text
are taken there.

Runs of words are named by hashes: a slice (taken from one 64-bit hash) and
another 64-bit hash. Two runs are taken for one only if both agree, 70 bits and
more for the tables for which it matters (1,024 slices: below one chance in
100,000 of a single such pair among 500 million runs). Words themselves are
compared as strings. Where the names of all kinds of runs would fill the disk, they
are shuffled some kinds at a time (``sums_in_turns``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize, shuffles_deleted, ship_package

#: Words of a block: what a Python worker holds at a time.
BLOCK_WORDS = 2_000_000
#: Reference text bytes for each slice of the runs, and the bounds of their number.
SLICE_BYTES, MIN_SLICES, MAX_SLICES = 16 << 20, 16, 4096

#: (hashes of the words, words of each text) -> hashes of the runs, an array of two rows for each kind
Runs = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]


# --- blocks ------------------------------------------------------------------------

def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(cell: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), kind)


def _pack_planes(a: np.ndarray) -> bytes:
    """Numbers byte by byte: the high bytes of small ones are zeros."""
    return _pack(a.view(np.uint8).reshape(-1, a.itemsize).T)


def _unpack_planes(cell: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(_unpack(cell, "u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pack_codes(codes: np.ndarray) -> bytes:
    return _pack_planes(codes.astype("<u4"))


def _unpack_codes(cell: bytes) -> np.ndarray:
    return _unpack_planes(cell, "<u4").astype(np.int64)


def _pack_names(names: np.ndarray) -> bytes:
    """Sorted names as their differences: the more names, the more zeros."""
    return _pack_planes(np.diff(names, prepend=np.uint64(0)).astype("<u8"))


def _unpack_names(cell: bytes) -> np.ndarray:
    return np.cumsum(_unpack_planes(cell, "<u8"), dtype=np.uint64)


def _gather(batches, words_of: Callable[[pa.RecordBatch], int]):
    """Tables of about ``BLOCK_WORDS`` words."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += words_of(b)
        if n >= BLOCK_WORDS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, i: int) -> pa.Array:
    c = table.column(i).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def _lengths(lists: pa.Array) -> np.ndarray:
    """Words of each text, -1 for null."""
    return pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int32)


def letter_words(texts: pa.Array) -> pa.Array:
    """The words ``[a-z]+`` of each text, as word arrays; null for null. One pass
    over the bytes of all texts: no other character has a byte of these letters."""
    raw = pc.fill_null(texts.cast(pa.large_string()), "")
    off = np.frombuffer(raw.buffers()[1], "<i8")[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[off[0]:off[-1]]
    off = off - off[0]
    letter = data - np.uint8(97) < 26
    first, last = letter.copy(), letter.copy()  # letters that open and that end a word
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    some = np.flatnonzero(np.diff(off))
    first[off[some]] = letter[off[some]]
    last[off[some + 1] - 1] = letter[off[some + 1] - 1]
    first = np.flatnonzero(first)
    ends = np.concatenate(([0], np.cumsum(np.flatnonzero(last) + 1 - first)))
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(data[letter].tobytes()))
    at = np.searchsorted(first, off).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), words, mask=texts.is_null())


def _split(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with word arrays in the place of texts (its key may be a string)."""
    is_text = [i > 0 and (pa.types.is_string(c.type) or pa.types.is_large_string(c.type)) for i, c in enumerate(batch.columns)]
    return pa.RecordBatch.from_arrays([letter_words(c) if t else c for c, t in zip(batch.columns, is_text, strict=True)], names=batch.schema.names)


def _as_one(size: np.ndarray, codes: np.ndarray, size0: np.ndarray, codes0: np.ndarray) -> np.ndarray:
    """Which texts have the same words, in their order, as their first text."""
    same, n = size == size0, np.maximum(size, 0)
    text = np.repeat(np.arange(len(size)), n)
    other = codes[same[text]] != codes0[np.repeat(same, np.maximum(size0, 0))]
    same[text[same[text]][other]] = False
    return same


def text_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows``: a key, then word arrays, or texts that are split into
    words ``[a-z]+`` here. A word array that equals the row's first one is kept as
    a mark.

    Stored as (block, keys, words, cells); the cells are, for each word array, the
    texts' numbers of words (-1: null, -2: as the first) and the words' codes."""
    ship_package(rows.sparkSession)
    key, *texts = rows.columns
    kind = rows.schema[key].dataType.simpleString()
    sent = [F.col(texts[0])] + [F.when(~F.col(texts[0]).eqNullSafe(F.col(t)), F.col(t)).alias(t) for t in texts[1:]]
    marks = [F.col(texts[0]).eqNullSafe(F.col(t)).alias(f"_same{i}") for i, t in enumerate(texts[1:])]
    n = len(texts)

    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for table in _gather(map(_split, batches), lambda b: sum(len(b.column(i + 1).flatten()) for i in range(n))):
            lists = [_column(table, i + 1) for i in range(n)]
            code = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
            codes = code.indices.to_numpy()
            order = np.argsort(-np.bincount(codes, minlength=len(code.dictionary)), kind="stable")  # frequent words first
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            codes, words, at, cells = rank[codes], code.dictionary.take(pa.array(order)), 0, []
            size0, codes0 = _lengths(lists[0]), codes[:len(lists[0].flatten())]
            for i, x in enumerate(lists):
                size, m = _lengths(x), len(x.flatten())
                mine = codes[at:at + m]
                if i:
                    sent = ~_column(table, n + i).to_numpy(zero_copy_only=False)
                    same = ~sent | _as_one(size, mine, size0, codes0)
                    mine = mine[np.repeat(~same, np.maximum(size, 0))]
                    size = np.where(same, -2, size).astype(np.int32)
                cells += [_pack(size), _pack_codes(mine)]
                at += m
            keys = _column(table, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                 pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.array([cells], pa.list_(pa.binary()))],
                names=["block", "keys", "words", "cells"])
            block += 1
            del table, lists, code, codes, words, cells, order, rank, size0, codes0, x, size, mine, keys
            pa.default_memory_pool().release_unused()  # the worker lives on

    packed = rows.select(key, *sent, *marks).mapInArrow(run, f"block long, keys array<{kind}>, words array<string>, cells array<binary>")
    return materialize(packed, "blocks")


def _texts(cells: list[bytes], i: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, codes) of word array ``i`` of a block."""
    size, codes = _unpack(cells[2 * i], "<i4"), _unpack_codes(cells[2 * i + 1])
    if i and (size == -2).any():
        size0, codes0 = _unpack(cells[0], "<i4"), _unpack_codes(cells[1])
        same, n0, n = size == -2, np.maximum(size0, 0), np.maximum(size, 0)
        new = np.where(same, size0, size)
        text = np.repeat(np.arange(len(size)), np.maximum(new, 0))
        out = np.empty(len(text), np.int64)
        out[same[text]] = codes0[np.repeat(same, n0)]
        out[~same[text]] = codes[np.repeat(~same, n)]
        size, codes = new, out
    return size, codes


def _as_first(cells: list[bytes], i: int) -> np.ndarray:
    return _unpack(cells[2 * i], "<i4") == -2


def _to_blocks(blocks: DataFrame, found: DataFrame):
    """Blocks with the rows that answer them."""
    return blocks.select(F.col("block").alias("at"), "keys", "words", "cells").groupBy("at").cogroup(found.groupBy("block"))


# --- words -------------------------------------------------------------------------

def class_counts(rows: DataFrame) -> DataFrame:
    """(word, c1, c0): how often the words ``[a-z]+`` stand in texts of class 1 and
    of class 0, for about ``BLOCK_WORDS`` words of ``rows`` (text, class) at a time;
    words that stand in texts of other classes alone have zeros."""
    ship_package(rows.sparkSession)

    def run(batches):
        split = (pa.RecordBatch.from_arrays([letter_words(b.column(0)), b.column(1)], names=["words", "y"]) for b in batches)
        for table in _gather(split, lambda b: len(b.column(0).flatten())):
            lists = _column(table, 0)
            code = lists.flatten().dictionary_encode()
            codes, y = code.indices.to_numpy(), np.repeat(_column(table, 1).to_numpy(), np.maximum(_lengths(lists), 0))
            counts = [np.bincount(codes[y == c], minlength=len(code.dictionary)) for c in (1, 0)]
            yield pa.RecordBatch.from_arrays([code.dictionary, *[pa.array(c, pa.int64()) for c in counts]], names=["word", "c1", "c0"])

    return rows.mapInArrow(run, "word string, c1 long, c0 long")


def word_values(blocks: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(block, i, value) for the words of the blocks that ``table`` (word, value) has."""
    words = blocks.select("block", F.posexplode("words").alias("i", "word"))
    return words.join(broadcast_if_small(table), "word").select("block", "i", F.col(value).alias("value"))


def weighted_words(blocks: DataFrame, weights: DataFrame, value: str, n_texts: int, by_text: bool = False) -> DataFrame:
    """(k, c, x): the known words of each text, what they add together; with
    ``by_text`` one row for a text that has any. The bits of ``c`` tell the word
    arrays; one that equals the first sends no rows of its own."""
    kind = blocks.schema["keys"].dataType.elementType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.select(["keys", "words", "cells"]).combine_chunks().to_batches():
            for j in range(r.num_rows):
                keys, cells = r.column(0)[j].values, [c.as_py() for c in r.column(2)[j]]
                n_words = len(r.column(1)[j].values)
                w = np.full(n_words, np.nan)
                w[right.column("i").to_numpy()] = right.column("value").to_numpy()
                for i in range(n_texts):
                    if i:
                        size, codes = _unpack(cells[2 * i], "<i4"), _unpack_codes(cells[2 * i + 1])
                        mask = np.full(len(size), 1 << i)
                    else:
                        size, codes = _texts(cells, 0)
                        mask = 1 + sum(_as_first(cells, k).astype(np.int64) << k for k in range(1, n_texts))
                        mask = np.broadcast_to(mask, len(size))
                    text = np.repeat(np.arange(len(size)), np.maximum(size, 0))
                    known = ~np.isnan(w[codes])
                    text, codes = text[known], codes[known]
                    if by_text:
                        x = np.bincount(text, w[codes], len(size))
                        text = np.flatnonzero(np.bincount(text, minlength=len(size)))
                        x = x[text]
                    else:
                        place, n = np.unique(text * max(1, n_words) + codes, return_counts=True)
                        text, x = place // max(1, n_words), n * w[place % max(1, n_words)]
                    out.append(pa.table([keys.take(pa.array(text)), pa.array(mask[text], pa.int32()), pa.array(x, pa.float64())], names=["k", "c", "x"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], left.schema.field("keys").type.value_type), pa.array([], pa.int32()), pa.array([], pa.float64())], names=["k", "c", "x"])

    found = word_values(blocks, weights, value)
    return _to_blocks(blocks, found).applyInArrow(run, f"k {kind.simpleString()}, c int, x double")


def cosines(blocks: DataFrame) -> DataFrame:
    """(k, cos) for each row: the cosine of the word counts of its first two
    word arrays, 0 if one has no word (``scoring.text_similarity``)."""
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        for b in batches:
            for j in range(b.num_rows):
                cells, v = [c.as_py() for c in b.column(1)[j]], max(1, len(b.column(2)[j].values))
                both = [_texts(cells, i) for i in (0, 1)]
                at = [np.repeat(np.arange(len(size)), np.maximum(size, 0)) * v + codes for size, codes in both]
                place, to = np.unique(np.concatenate(at), return_inverse=True)
                x, y = (np.bincount(t, minlength=len(place)).astype(float) for t in (to[:len(at[0])], to[len(at[0]):]))
                xx, yy, xy = (np.bincount(place // v, z, len(both[0][0])) for z in (x * x, y * y, x * y))
                cos = np.divide(xy, np.sqrt(xx) * np.sqrt(yy), out=np.zeros(len(xx)), where=(xx > 0) & (yy > 0))
                yield pa.RecordBatch.from_arrays([b.column(0)[j].values, pa.array(cos, pa.float64())], names=["k", "cos"])

    return blocks.select("keys", "cells", "words").mapInArrow(run, f"k {kind}, cos double")


# --- runs of words -----------------------------------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_words(words: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each word, as two rows."""
    raw = b"".join([hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest() for w in words])
    return np.array(memoryview(raw).cast("Q") if raw else [], np.uint64).reshape(-1, 2).T.copy()


_FACTORS = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F]], np.uint64)
#: The hashes of what stands before the first and after the last word.
_EDGE = np.array([[0x165667B19E3779F9], [0x27D4EB2F165667C5]], np.uint64)


def _then(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``a`` followed by ``b``."""
    return _mix(a * _FACTORS + b)


def pairs(h: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Kinds of the bigram model: each word with its successor, and that word alone."""
    first = opening(size)
    return [_then(h[:, first], h[:, first + 1]), h[:, first]]


def opening(size: np.ndarray) -> np.ndarray:
    """Places of the words that have a successor in their text."""
    at = np.ones(int(size.sum()), bool)
    at[np.cumsum(size)[size > 0] - 1] = False
    return np.flatnonzero(at)


def centres(h: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Kinds of the two-sided model, for each word with its neighbours l and r
    (the edge at the ends): (l, word, r); (l, r); (l, word), and then each text's last
    word with the edge; l; r."""
    some = size[size > 0]
    last = np.cumsum(some) - 1
    left, right = np.roll(h, 1, axis=1), np.roll(h, -1, axis=1)
    left[:, last - some + 1], right[:, last] = _EDGE, _EDGE
    lw = _then(left, h)
    return [_then(lw, right), _then(left, right), np.concatenate((lw, _then(h[:, last], np.broadcast_to(_EDGE, (2, len(last))))), axis=1), left, right]


def _in_slices(given: np.ndarray, part: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names sorted within their slices: (names, their order before, where a new one begins, which of those each slice begins with)."""
    order = np.argsort(part, kind="stable")
    name = given[order]
    del given
    ends = np.concatenate(([0], np.cumsum(np.bincount(part, minlength=slices))))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):  # a slice at a time stays in the processor's cache
        mine = np.argsort(name[a:b])
        name[a:b], order[a:b] = name[a:b][mine], order[a:b][mine]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    new[ends[:-1][ends[:-1] < len(name)]] = True
    at = np.flatnonzero(new)
    return name, order, at, np.searchsorted(at, ends)


def _slice_of(h1: np.ndarray, slices: int) -> np.ndarray:
    return (h1 & np.uint64(slices - 1)).astype(np.uint16)


def _places(order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The place of each run's name, from what :func:`_in_slices` returns."""
    place = np.empty(len(order), np.int32)
    place[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.append(at, len(order))))
    return place


def _distinct(h: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names, where each slice's begin, how often each stands, the place of each run's name)."""
    name, order, at, begins = _in_slices(h[0], _slice_of(h[1], slices), slices)
    return name[at], begins, np.diff(np.append(at, len(name))), _places(order, at)


_ROWS = "kind int, slice int, block long, names binary, n binary"


def _run_rows(runs: list[np.ndarray], slices: int, block: int | None):
    """A row for each kind and slice: the names, sorted, and how often they stand (``block`` None) or whose they are."""
    for kind, h in enumerate(runs):
        name, at, n, _ = _distinct(h, slices)
        some = np.flatnonzero(np.diff(at))
        cells = [pa.Array.from_buffers(pa.binary(), slices, [None, pa.py_buffer((at * x.itemsize).astype("<i4").tobytes()), pa.py_buffer(x.tobytes())])
                 for x in ([name.astype("<u8"), n.astype("<u4")] if block is None else [name.astype("<u8")])]
        take = pa.array(some)
        cells = [c.take(take) for c in cells] + ([] if block is None else [pa.nulls(len(some), pa.binary())])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind), pa.int32()), pa.array(some, pa.int32()),
                                          pa.nulls(len(some), pa.int64()) if block is None else pa.array(np.full(len(some), block), pa.int64()), *cells],
                                         names=["kind", "slice", "block", "names", "n"])


def slices_of(n_bytes: int) -> int:
    """Slices for the runs of a corpus of ``n_bytes``."""
    return min(MAX_SLICES, max(MIN_SLICES, 1 << max(0, int(n_bytes) // SLICE_BYTES).bit_length()))


class RunCounts:
    """How often the runs of ``runs`` stand in a corpus (a frame of one column, word
    arrays), by slice; with the number of distinct words. With ``store`` the counts
    are kept as a table, for models that are asked more than once."""

    def __init__(self, words: DataFrame, runs: Runs, n_bytes: int, store: bool = False):
        ship_package(words.sparkSession)
        self.runs = runs
        self.slices = slices = slices_of(n_bytes)

        def count(batches):
            for table in _gather(batches, lambda b: len(b.column(0).flatten())):
                lists = _column(table, 0)
                code = lists.flatten().dictionary_encode()
                h = hash_words(code.dictionary.to_pylist())[:, code.indices.to_numpy()]
                yield from _run_rows(runs(h, np.maximum(_lengths(lists), 0)), slices, None)

        self.rows = words.mapInArrow(count, _ROWS)
        if store:
            self.rows = materialize(self.rows, "run-counts")
        column = words.columns[0]
        self.words = int(words.select(F.explode(column).alias("w")).distinct().count())

    def sums(self, blocks: DataFrame, i: int, cost: Callable[[list[np.ndarray], np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """(k, nll, n, size) for each text of word array ``i`` of the blocks: the sum of
        ``cost``, how many runs it is of, the text's words (null for null). ``cost`` has
        the counts of all runs of a block, the texts' numbers of words and the number of
        distinct words, and returns a cost for each run and that run's text."""
        runs, slices, vocab = self.runs, self.slices, max(1, self.words)

        def ask(batches):
            for b in batches:
                for j in range(b.num_rows):
                    size, codes = _texts([c.as_py() for c in b.column(2)[j]], i)
                    h = hash_words(b.column(1)[j].values.to_pylist())[:, codes]
                    yield from _run_rows(runs(h, np.maximum(size, 0)), slices, b.column(0)[j].as_py())

        def answer(table: pa.Table) -> pa.Table:
            given = table.column("block").is_null().to_numpy()
            names, ns = table.column("names").to_pylist(), table.column("n").to_pylist()
            known = [(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u4")) for a, b, g in zip(names, ns, given, strict=True) if g]
            name = np.concatenate([a for a, _ in known]) if known else np.empty(0, "<u8")
            order = np.argsort(name)
            name = name[order]
            at = np.flatnonzero(np.concatenate((np.ones(min(1, len(name)), bool), name[1:] != name[:-1])))
            # a last entry that no run looks up
            total = np.append(np.add.reduceat(np.concatenate([b for _, b in known]).astype(np.int64)[order], at), 0) if known else np.zeros(1, np.int64)
            name = name[at]
            asked, out = np.flatnonzero(~given), []
            for a in asked.tolist():
                mine = np.frombuffer(names[a], "<u8")
                place = np.searchsorted(name, mine)
                hit = place < len(name)
                hit[hit] = name[place[hit]] == mine[hit]
                out.append(_pack(total[np.where(hit, place, len(name))].astype("<i8")))
            rows = table.take(pa.array(asked))
            return pa.table([rows.column("block"), rows.column("kind"), rows.column("slice"), pa.array(out, pa.binary())], names=["block", "kind", "slice", "counts"])

        def total(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            order = pc.sort_indices(right, [("kind", "ascending"), ("slice", "ascending")])
            right = right.take(order)
            kind = right.column("kind").to_numpy()
            cells = right.column("counts").to_pylist()
            for r in left.select(["keys", "words", "cells"]).combine_chunks().to_batches():
                for j in range(r.num_rows):
                    size, codes = _texts([c.as_py() for c in r.column(2)[j]], i)
                    n = np.maximum(size, 0)
                    h = hash_words(r.column(1)[j].values.to_pylist())[:, codes]
                    counts = []
                    for k, run in enumerate(runs(h, n)):
                        mine = [_unpack(cells[x], "<i8") for x in np.flatnonzero(kind == k).tolist()]
                        counts.append((np.concatenate(mine) if mine else np.empty(0, np.int64))[_distinct(run, slices)[3]])
                    costs, text = cost(counts, n, vocab)
                    out.append(pa.table([r.column(0)[j].values, pa.array(np.bincount(text, costs, len(n)), pa.float64()),
                                         pa.array(np.bincount(text, minlength=len(n)), pa.int64()), pa.array(size, pa.int64(), mask=size < 0)], names=["k", "nll", "n", "size"]))
            none = pa.table([pa.array([], left.schema.field("keys").type.value_type), *[pa.array([], t) for t in (pa.float64(), pa.int64(), pa.int64())]], names=["k", "nll", "n", "size"])
            return pa.concat_tables(out) if out else none

        asked = blocks.select("block", "words", "cells").mapInArrow(ask, _ROWS)
        found = self.rows.unionAll(asked).groupBy("kind", "slice").applyInArrow(answer, "block long, kind int, slice int, counts binary")
        kind = blocks.schema["keys"].dataType.elementType.simpleString()
        return _to_blocks(blocks, found).applyInArrow(total, f"k {kind}, nll double, n long, size long")


def pair_cost(counts: list[np.ndarray], size: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """-ln P(b | a) = -ln((c(a, b) + 1) / (c(a) + v))."""
    cab, ca = counts
    text = np.repeat(np.arange(len(size)), size)[opening(size)]
    return -np.log((cab + 1.0) / (ca + float(vocab))), text


def centre_cost(counts: list[np.ndarray], size: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray]:
    """-ln P(w | l, r) of the two-sided model (``scoring.TwoSided``)."""
    c3, clr, two, cl, cr = counts
    m = int(size.sum())
    clw, cwr = two[:m], np.roll(two[:m], -1)
    cwr[np.cumsum(size[size > 0]) - 1] = two[m:]
    q = (clw + 1.0) / (cl + float(vocab))
    q += (cwr + 1.0) / (cr + float(vocab))
    q /= 2
    q += c3
    q /= clr + 1.0
    return -np.log(q, out=q), np.repeat(np.arange(len(size)), size)


# --- runs of words, some kinds at a time -------------------------------------------

#: Words of more bytes are hashed one by one.
LONG_WORD = 64

#: (words as codes, words of each text, the code of the edge) -> for each turn its kinds of runs, a kind as the codes that follow one another
Turns = Callable[[np.ndarray, np.ndarray, int], list[list[tuple[np.ndarray, ...]]]]


def centre_turns(codes: np.ndarray, size: np.ndarray, edge: int) -> list[list[tuple[np.ndarray, ...]]]:
    """The kinds of :func:`centres`, in turns of about as many names."""
    some = size[size > 0]
    last = np.cumsum(some) - 1
    left, right = np.roll(codes, 1), np.roll(codes, -1)
    left[last - some + 1], right[last] = edge, edge
    two = np.concatenate((left, codes[last])), np.concatenate((codes, np.full(len(last), edge, codes.dtype)))
    return [[(left, codes, right)], [(left, right)], [two, (left,), (right,)]]


def _both(cells: list[bytes], given: int | None, asked: int | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words of each text, codes) of the corpus' texts and of those that are asked
    about, none for ``None``; texts marked as the first are in the first alone."""
    out = [(_unpack(cells[2 * i], "<i4"), _unpack_planes(cells[2 * i + 1], "<i4")) if i is not None else None for i in (given, asked)]
    none = np.zeros(len((out[0] or out[1])[0]), np.int32), np.empty(0, np.int32)
    return [x or none for x in out]


def _together(first: tuple[np.ndarray, ...], second: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(first, second, strict=True)) if len(second[0]) else first


def _lane(h: np.ndarray, run: tuple[np.ndarray, ...], lane: int) -> np.ndarray:
    """One of the two hashes of runs given as codes (:func:`_then`)."""
    out = h[lane][run[0]]
    for more in run[1:]:
        out *= _FACTORS[lane, 0]
        out += h[lane][more]
        _mix(out)
    return out


def _run_names(h: np.ndarray, run: tuple[np.ndarray, ...], slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    part = _slice_of(_lane(h, run, 1), slices)
    return _in_slices(_lane(h, run, 0), part, slices)


def _word_places(h: np.ndarray, codes: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, where each slice's begin, the place of each word's name): the words that stand there, not each time they do."""
    some = np.flatnonzero(np.bincount(codes, minlength=h.shape[1]))
    name, begins, _, place = _distinct(h[:, some], slices)
    to = np.zeros(h.shape[1], np.int32)
    to[some] = place
    return name, begins, to[codes]


def _named(h: np.ndarray, run: tuple[np.ndarray, ...], m: int, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, where each slice's begin, how often each is among the first ``m``) of runs
    given as codes; ``h`` has the words' hashes by code."""
    if len(run) == 1:
        name, begins, place = _word_places(h, run[0], slices)
        return name, begins, np.bincount(place[:m], minlength=len(name)).astype("<u4")
    name, order, at, begins = _run_names(h, run, slices)
    return name[at], begins, np.add.reduceat(order < m, at, dtype="<u4") if len(at) else np.empty(0, "<u4")


def _run_places(h: np.ndarray, run: tuple[np.ndarray, ...], slices: int) -> np.ndarray:
    """The place of each run's name among those of :func:`_named`."""
    if len(run) == 1:
        return _word_places(h, run[0], slices)[2]
    _, order, at, _ = _run_names(h, run, slices)
    return _places(order, at)


def _hashes(words: pa.Array) -> np.ndarray:
    """Two hashes of each of a block's words, the edge's as the last: eight bytes of all words at a time (not those of :func:`hash_words`)."""
    words = words.cast(pa.large_string())
    off = np.frombuffer(words.buffers()[1], "<i8")[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    data = np.concatenate((data[off[0]:off[-1]], np.zeros(8, np.uint8))) if len(words) else np.zeros(8, np.uint8)
    first, size = off[:-1] - off[0], np.diff(off)
    h = np.empty((2, len(words) + 1), np.uint64)
    h[:, -1:] = _EDGE
    h[:, :-1] = _mix(size.astype(np.uint64) * _FACTORS + _EDGE)
    window = np.lib.stride_tricks.sliding_window_view(data, 8)
    at, done = np.flatnonzero(size <= LONG_WORD), 0
    while len(at := at[size[at] > done]):
        part = window[first[at] + done].view("<u8").ravel()
        part &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * (8 - np.minimum(size[at] - done, 8)).astype(np.uint64))
        h[:, at] = _then(h[:, at], part)
        done += 8
    long = np.flatnonzero(size > LONG_WORD)
    h[:, long] = hash_words(words.take(pa.array(long)).to_pylist())
    return h


def _turn_rows(blocks: DataFrame, given: int | None, asked: int | None, turns: Turns, turn: int, slices: int) -> DataFrame:
    """A row for each block, kind of the turn and slice: the names of its runs, sorted,
    and how often they stand in its texts of the corpus (word array ``given``). ``block`` is null if none is asked for."""

    def run(batches):
        for b in batches:
            for j in range(b.num_rows):
                words = b.column(1)[j].values
                h = _hashes(words)
                kinds = [turns(codes, np.maximum(size, 0), len(words)) for size, codes in _both([c.as_py() for c in b.column(2)[j]], given, asked)]
                first = sum(map(len, kinds[0][:turn]))
                for kind, (x, y) in enumerate(zip(*(k[turn] for k in kinds), strict=True), first):
                    name, at, n = _named(h, _together(x, y), len(x[0]), slices)
                    some = np.flatnonzero(np.diff(at))
                    ends = [(at[s], at[s + 1]) for s in some.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind), pa.int32()), pa.array(some, pa.int32()),
                                                      pa.array([None if asked is None else b.column(0)[j].as_py()] * len(some), pa.int64()),
                                                      pa.array([_pack_names(name[x:y]) for x, y in ends], pa.binary()),
                                                      pa.array([_pack_planes(n[x:y]) for x, y in ends], pa.binary())], names=["kind", "slice", "block", "names", "n"])

    return blocks.select("block", "words", "cells").mapInArrow(run, _ROWS)


def _turn_counts(table: pa.Table) -> pa.Table:
    """The rows of a kind and slice that ask, with the counts of their names in all rows."""
    names = [_unpack_names(c) for c in table.column("names").to_pylist()]
    ends = np.cumsum([0, *map(len, names)]).tolist()
    name, n = np.concatenate(names), np.concatenate([_unpack_planes(c, "<u4") for c in table.column("n").to_pylist()])
    del names
    order = np.argsort(name)
    name = name[order]
    at = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1])))
    counts = np.empty(len(name), "<u8")
    counts[order] = np.repeat(np.add.reduceat(n[order], at, dtype=np.uint64), np.diff(np.append(at, len(name))))
    asked = np.flatnonzero(~table.column("block").is_null().to_numpy())
    rows = table.take(pa.array(asked))
    cells = [_pack_planes(counts[ends[a]:ends[a + 1]]) for a in asked.tolist()]
    return pa.table([rows.column("block"), rows.column("kind"), rows.column("slice"), pa.array(cells, pa.binary())], names=["block", "kind", "slice", "counts"])


def _vocabulary(blocks: DataFrame, i: int) -> int:
    """The number of distinct words of word array ``i`` of the blocks."""

    def run(batches):
        for b in batches:
            for j in range(b.num_rows):
                words = b.column(0)[j].values
                there = np.bincount(_texts([c.as_py() for c in b.column(1)[j]], i)[1], minlength=len(words)) > 0
                yield pa.RecordBatch.from_arrays([words.filter(pa.array(there))], names=["w"])

    with shuffles_deleted(blocks.sparkSession):
        return blocks.select("words", "cells").mapInArrow(run, "w string").distinct().count()


def sums_in_turns(blocks: DataFrame, given: int | None, asked: int, corpus: DataFrame | None, turns: Turns, n_bytes: int,
                  cost: Callable[[list[np.ndarray], np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """:meth:`RunCounts.sums` for word array ``asked`` of the blocks, with the counts of
    the blocks' own word array ``given`` (the first), or of the first one of the blocks ``corpus``.

    The runs of a corpus are many times its size on disk, and a text and its rewrite
    have most of theirs in common. So a block names a run once, whether it has it from
    one or the other, and the names meet a turn after the other: the answers are stored,
    and what was shuffled for them is deleted before the next turn."""
    ship_package(blocks.sparkSession)
    slices, vocab = slices_of(n_bytes), max(1, _vocabulary(*((blocks, given) if corpus is None else (corpus, 0))))
    found = None
    for turn in range(len(turns(np.empty(0, np.int64), np.empty(0, np.int32), 0))):
        rows = _turn_rows(blocks, given, asked, turns, turn, slices)
        if corpus is not None:
            rows = rows.unionAll(_turn_rows(corpus, 0, None, turns, turn, slices))
        with shuffles_deleted(blocks.sparkSession):
            counts = materialize(rows.groupBy("kind", "slice").applyInArrow(_turn_counts, "block long, kind int, slice int, counts binary"), "turn-counts")
        found = counts if found is None else found.unionAll(counts)

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        right = right.take(pc.sort_indices(right, [("kind", "ascending"), ("slice", "ascending")]))
        kinds, cells = right.column("kind").to_numpy(), right.column("counts")
        for r in left.select(["keys", "words", "cells"]).combine_chunks().to_batches():
            for j in range(r.num_rows):
                both = _both([c.as_py() for c in r.column(2)[j]], given, asked)
                words = r.column(1)[j].values
                h, counts = _hashes(words), ([], [])
                runs = [[kind for turn in turns(codes, np.maximum(size, 0), len(words)) for kind in turn] for size, codes in both]
                for k, (x, y) in enumerate(zip(*runs, strict=True)):
                    mine = [_unpack_planes(cells[c].as_py(), "<u8") for c in np.flatnonzero(kinds == k).tolist()]
                    n = np.concatenate(mine) if mine else np.empty(0, "<u8")
                    n = (n.astype("<u4") if len(n) and n.max() < 1 << 32 else n)[_run_places(h, _together(x, y), slices)]
                    counts[0].append(n[:len(x[0])])
                    counts[1].append(n[len(x[0]):])
                del runs
                (size0, _), (size, _) = both
                same, sums = size == -2, []
                for c, s in zip(counts, (size0, size), strict=True):
                    costs, text = cost(c, np.maximum(s, 0), vocab)
                    sums.append((np.bincount(text, costs, len(s)), np.bincount(text, minlength=len(s)), s))
                nll, n, size = (np.where(same, x, y) for x, y in zip(*sums, strict=True))
                out.append(pa.table([r.column(0)[j].values, pa.array(nll, pa.float64()), pa.array(n, pa.int64()), pa.array(size, pa.int64(), mask=size < 0)],
                                    names=["k", "nll", "n", "size"]))
        none = pa.table([pa.array([], left.schema.field("keys").type.value_type), *[pa.array([], t) for t in (pa.float64(), pa.int64(), pa.int64())]], names=["k", "nll", "n", "size"])
        return pa.concat_tables(out) if out else none

    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    return _to_blocks(blocks, found).applyInArrow(total, f"k {kind}, nll double, n long, size long")
