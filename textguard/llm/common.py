"""Helpers shared by the corpus operators: stored intermediates, packed
numpy payloads, byte-level word hashing and code-point crc."""

from __future__ import annotations

import contextlib
import os
import struct
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, prepare

#: Words of every contract: runs of anything but space and U+0009-U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Set while a step is stored: the shuffle files of a finished job go at once
#: instead of waiting for the driver's garbage collector.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Free a job's shuffle files when it ends."""
    old = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, old)


#: Bytes of an Arrow batch handed to a Python worker, however long the texts.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The library's session settings, and batches bounded by bytes."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


#: A stored table is broadcast only if its files, this many times larger in
#: memory, stay below the bound; beyond that the join shuffles both sides.
BROADCAST_MAX, EXPANSION = 64 << 20, 6


class Stored:
    """A stored table with the size of its files."""

    def __init__(self, df: DataFrame, path: str):
        self.df, self.path = df, path

    def n_bytes(self) -> int:
        sc = self.df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(self.path)
        return int(p.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(p).getLength())

    def small(self) -> DataFrame:
        """The table, marked for broadcast if its measured size allows it."""
        return F.broadcast(self.df) if self.n_bytes() * EXPANSION <= BROADCAST_MAX else self.df


def stored(df: DataFrame, name: str) -> Stored:
    """Write ``df`` as Parquet in the shared folder of ``spark.checkpoint.dir``
    and read it back: a lost executor costs at most the step it ran."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")
    with shuffle_cleanup(spark):
        df.write.option("compression", "zstd").parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def store(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name).df


def forget_words() -> None:
    """Give back what earlier tasks of other operators left in this worker:
    the words an encoder keeps, Arrow's unused memory and the C heap's."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa
    tokens = sys.modules.get("textguard.llm.tokens")
    if tokens is not None:
        tokens.encoder.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        have.add(n.lower())
        out.append(n)
    return out


def one(df: DataFrame) -> tuple:
    """The single row of an ungrouped aggregate."""
    return tuple(df.first())


def to_int(v, default: int = 0) -> int:
    return default if v is None else int(v)


# --- numpy arrays in one binary cell --------------------------------------------------

def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd-compressed cell; :func:`unpack_arrays` reads it."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        code = a.dtype.str.encode()
        head.append(struct.pack("<B", len(code)) + code + struct.pack("<q", a.size))
        body.append(a.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def unpack_arrays(cell: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(cell)
    n, at = raw[0], 1
    shapes = []
    for _ in range(n):
        k = raw[at]
        code = raw[at + 1:at + 1 + k].decode()
        size, = struct.unpack_from("<q", raw, at + 1 + k)
        shapes.append((np.dtype(code), size))
        at += 9 + k
    out = []
    for dt, size in shapes:
        out.append(np.frombuffer(raw, dt, size, at))
        at += size * dt.itemsize
    return out


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64's)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def spread_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``range(s, s + n)`` over the given starts and lengths."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


# --- words ---------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least ``n``
    of each; kept up to the longest buffer of a worker."""
    have = _POW.get(0)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        for k, b in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word (``WORD``) of the UTF-8 bytes ``data``."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    word = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    s, e = edge[0::2], edge[1::2]
    up, down = _powers(len(b) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)], dtype=np.uint64)))
    return mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every run of ``k`` words; a shorter text is one shingle of all
    its words; no words, no shingles."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    kk = min(k, n)
    h = np.full(n - kk + 1, kk, np.uint64)
    for j in range(kk):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[j:n - kk + 1 + j]
    return mix64(h)


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (the held-out rule of the labels)."""
    return F.crc32(doc_id.cast("string")) % 5
