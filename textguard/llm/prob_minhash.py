"""Near-duplicate documents by ProbMinHash.

Method: a document is the weighted set of its five-word shingles (weight: how
often the shingle stands in it). Every shingle is a Poisson process whose rate
is its weight; its arrivals fall into one of ``SLOTS`` slots. A slot keeps its
earliest arrival, and a process stops once its next arrival is later than
every slot's (early termination: no later point can matter). Two documents
agree in a slot with the probability Jaccard J_P of their weighted shingles.
Bands of slots give candidates, and the exact J_P of the shingles decides:
documents of J_P >= ``SIMILARITY`` are linked, and linked documents form
classes. For texts that repeat no shingle J_P is the plain Jaccard similarity.

How it is dealt out over Spark:

* Texts with equal words are one node (their 128-bit key is aggregated
  map-side), so thousands of copies are one row of everything that follows.
* A band bucket sends each member to the bucket's smallest node only: n - 1
  candidates, not n squared. Verified links are joined to components.
* A bucket that then still holds different components may hide a link between
  members that are not its smallest. Those buckets are gone through in pairs
  of chunks of about ``CHUNK`` members: pairs across components whose sketches
  agree well enough are verified there, until the components are joined. So a
  class is whole, a task gets no more than two chunks of a bucket, however many
  texts it has, and no list of pairs is written.

A pair of J_P 0.8 misses all bands with probability below 1e-4.

Edge cases: words are runs of anything but white space, lower case; a text of
one to four words is one shingle; null, empty and blank texts are in no class
but their own; a null doc_id takes the class of its text (null if no other
row has that text); rows that share a doc_id with different texts are texts of
their own, each in the class of its text. :func:`keep_first` decides by row, id
and text together, so such a text stays if no other holds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_words, fresh, mix64, one, pack_arrays, shingle_hashes, stored, to_int, unpack_arrays, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 32
SLOTS = ROWS * BANDS
CHUNK = 1024
#: Sketches agree in at least this share of slots if J_P >= 0.8 (5 sigma).
LIKELY = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / SLOTS) ** 0.5
#: Words sketched together (bounds a worker's memory).
WORDS_AT_ONCE = 200_000


def weighted_shingles(words: np.ndarray, k: int = SHINGLE):
    """Distinct shingles of one text and how often each stands in it."""
    return np.unique(shingle_hashes(words, k), return_counts=True)


def prob_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Sketches (n_docs x slots) of weighted shingles, given as parallel
    arrays. All processes advance together, one arrival a round; those whose
    arrival is later than all slots of their document stop for good."""
    arrival = np.full(n_docs * slots, np.inf)
    winner = np.zeros(n_docs * slots, np.uint64)
    time, seed = np.zeros(len(doc)), shingle.copy()
    rate = weight.astype(np.float64)
    step = 0
    while len(doc):
        step += 1
        r = mix64(seed + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate
        slot = (mix64(r ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(slots)).astype(np.int64) + doc * slots
        early = time < arrival[slot]
        at = slot[early]
        np.minimum.at(arrival, at, time[early])
        won = arrival[at] == time[early]
        winner[at[won]] = seed[early][won]
        last = arrival.reshape(n_docs, slots).max(axis=1) if step < 8 or step % 8 == 0 else last
        on = time < last[doc]
        doc, seed, rate, time = doc[on], seed[on], rate[on], time[on]
    return winner.reshape(n_docs, slots)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One 64-bit key a band (n_docs x BANDS)."""
    s = sketch.reshape(len(sketch), BANDS, ROWS)
    h = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), s.shape[:2]).copy()
    for j in range(ROWS):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j])
    return h.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets, each (sorted keys, weights):
    sum over common d of 1 / sum over d' of max(a(d')/a(d), b(d')/b(d))."""
    (ka, wa), (kb, wb) = a, b
    common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:  # no shingle repeats: the plain Jaccard
        return len(common) / (len(ka) + len(kb) - len(common))
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(y / x, kind="stable")  # common elements by ratio; max() picks a's side up to d's own ratio
    x, y = x[order], y[order]
    low = only_a + np.cumsum(x)
    high = only_b + np.concatenate((np.cumsum(y[::-1])[::-1][1:], [0.0]))
    return float((1.0 / (low / x + high / y)).sum())


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, k1, k2, sketch binary, bands array<long>); ``row`` is a hash
    of the text; k1, k2 (the key of the text's words), sketch and bands are null
    for texts without words."""

    def flush(ids: list, rows: list, words: list[np.ndarray]):
        k1, k2, parts, owner = [], [], [], []
        sets = [weighted_shingles(w) for w in words]
        has = [i for i, w in enumerate(words) if len(w)]
        for w in words:
            d = hashlib.blake2b(w.tobytes(), digest_size=16).digest() if len(w) else None
            k1.append(int.from_bytes(d[:8], "little", signed=True) if d else None)
            k2.append(int.from_bytes(d[8:], "little", signed=True) if d else None)
        sk = np.empty((0, SLOTS), np.uint64)
        if has:
            doc = np.repeat(np.arange(len(has)), [len(sets[i][0]) for i in has])
            sk = prob_minhash(doc, np.concatenate([sets[i][0] for i in has]), np.concatenate([sets[i][1] for i in has]), len(has))
        keys = band_keys(sk)
        short = (sk >> np.uint64(48)).astype(np.uint16)
        at = {i: j for j, i in enumerate(has)}
        return pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
            pa.array([short[at[i]].tobytes() if i in at else None for i in range(len(ids))], pa.binary()),
            pa.array([keys[at[i]] if i in at else None for i in range(len(ids))], pa.list_(pa.int64()))],
            names=["doc_id", "row", "k1", "k2", "sketch", "bands"])

    def run(batches: Iterator[pa.RecordBatch]):
        forget_words()
        ids, rows, words, n = [], [], [], 0
        for b in batches:
            for i, r, t in zip(b.column(0), b.column(1), b.column(2), strict=True):
                w = word_hashes((t.as_py() or "").lower().encode())
                ids.append(i.as_py())
                rows.append(r.as_py())
                words.append(w)
                n += len(w)
                if n >= WORDS_AT_ONCE or len(ids) >= 2000:
                    yield flush(ids, rows, words)
                    ids, rows, words, n = [], [], [], 0
        if ids:
            yield flush(ids, rows, words)

    return (docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
            .mapInArrow(run, "doc_id long, row long, k1 long, k2 long, sketch binary, bands array<long>"))


def _shingle_sets(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(node, cell): the packed weighted shingles of the documents in ``ids``."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([
                    pack_arrays(*(lambda s: (s[0], s[1].astype(np.int32)))(weighted_shingles(word_hashes((t or "").lower().encode()))))
                    for t in part.column(1).to_pylist()], pa.binary())], names=["node", "cell"])

    return (docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).join(ids, "node", "left_semi")
            .mapInArrow(run, "node long, cell binary"))


def _verified(docs: DataFrame, pairs: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact J_P reaches ``similarity``, stored with it."""

    def run(batches):
        for b in batches:
            cache: dict[bytes, tuple] = {}
            score = []
            for x, y in zip(b.column("ca").to_pylist(), b.column("cb").to_pylist(), strict=True):
                if y not in cache:
                    cache = {y: tuple(unpack_arrays(y))}
                score.append(probability_jaccard(tuple(unpack_arrays(x)), cache[y]))
            s = pa.array(score, pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), s], names=["a", "b", "similarity"]).filter(pa.compute.greater_equal(s, similarity - 1e-12))

    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids")
    sets = stored(_shingle_sets(docs, ids.small(), key, text), "shingles").df
    got = (pairs.join(sets.select(F.col("node").alias("a"), F.col("cell").alias("ca")), "a")
           .join(sets.select(F.col("node").alias("b"), F.col("cell").alias("cb")), "b")
           .select("a", "b", "ca", "cb").mapInArrow(run, "a long, b long, similarity double"))
    return stored(got, "links").df


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component. Labels take
    the least label of the neighbours and then jump to their label's label, so
    the rounds grow with the logarithm of the longest path; every round is
    stored."""
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges").df
    label = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots").df
    while True:
        near = (both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m")))
        step = label.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = stored(step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "roots").df
        moved = to_int(one(new.agg(F.count_if(F.col("old") != F.col("root"))))[0])
        label = new.select("node", "root")
        if not moved:
            return label


def _hidden_links(docs: DataFrame, nodes: DataFrame, buckets: DataFrame, roots: DataFrame, key: str, text: str, similarity: float) -> DataFrame:
    """Links across components that no bucket's smallest node has shown.

    Buckets that hold two components are dealt out as pairs of chunks; a task
    compares the sketches of its two chunks and verifies likely pairs, best
    first, that nothing has joined yet. A pair is verified in its first common
    band only, and a task returns at most one link per member."""
    member = buckets.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = (member.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("lead"), F.min("root").alias("r0"), F.max("root").alias("r1"))
             .where("n > 2 and r0 <> r1").select("band", "lead", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    rows = member.join(mixed, "band").where("node <> lead").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    # a chunk meets every chunk once: (c0, c1) with c0 <= c1
    cells = stored(rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "band", "node", "root", F.least("chunk", "other").alias("c0"), F.greatest("chunk", "other").alias("c1"), "chunk"), "cells").df
    deals = 1 + cells.count() // CHUNK
    sets = stored(_shingle_sets(docs, stored(cells.select("node").distinct(), "ids").small(), key, text), "shingles").df
    cells = cells.join(nodes.select("node", "sketch", "bands"), "node").join(sets, "node")

    def run(table: pa.Table) -> pa.Table:
        band, c0, c1, node, root, chunk = (np.array(table.column(c).to_pylist(), np.int64) for c in ("band", "c0", "c1", "node", "root", "chunk"))
        sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(node), SLOTS)
        keys = np.array(table.column("bands").to_pylist(), np.int64)
        cell = table.column("cell")
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        order = np.lexsort((c1, c0, band))
        cut = np.flatnonzero((np.diff(band[order]) != 0) | (np.diff(c0[order]) != 0) | (np.diff(c1[order]) != 0)) + 1
        out = []
        for g in np.split(order, cut):
            across = c0[g[0]] != c1[g[0]]
            left = g[chunk[g] == c0[g[0]]] if across else g
            right = g[chunk[g] == c1[g[0]]] if across else g
            tries = []
            for i in left:
                j = right[(root[right] != root[i]) & ((node[right] > node[i]) | across)]
                agree = (sk[j] == sk[i]).sum(axis=1)
                on = agree >= LIKELY * SLOTS
                j, agree = j[on], agree[on]
                if len(j):  # the first band in which both stand is this one
                    first = keys[j][np.arange(len(j)), (keys[j] == keys[i]).argmax(axis=1)] == band[i]
                    tries += [(-a, int(i), int(x)) for a, x in zip(agree[first].tolist(), j[first].tolist(), strict=True)]
            tries.sort()
            sets: dict[int, tuple] = {}
            for _, i, j in tries:
                a, b = find(int(root[i])), find(int(root[j]))
                if a == b:
                    continue
                for x in (i, j):
                    if x not in sets:
                        sets[x] = tuple(unpack_arrays(cell[x].as_py()))
                s = probability_jaccard(sets[i], sets[j])
                if s >= similarity - 1e-12:
                    up[max(a, b)] = min(a, b)
                    out.append((max(int(node[i]), int(node[j])), min(int(node[i]), int(node[j])), s))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64()),
                         "similarity": pa.array([o[2] for o in out], pa.float64())})

    deal = F.pmod(F.xxhash64("band", "c0", "c1"), F.lit(deals)).alias("deal")
    return cells.select(deal, "*").groupBy("deal").applyInArrow(run, "a long, b long, similarity double")


def _rows(docs: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows, links): ``rows`` has doc_id, row, whether the text has words, the
    class ``c`` and its name class_id of every row of ``docs`` (two texts of one
    id may give their classes one name); ``links`` as of :func:`near_duplicates`."""
    sk = stored(sketches(docs, key, text), "sketches").df
    shared = stored(sk.where("doc_id is not null").groupBy("doc_id").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least <> most")
                    .select("doc_id", "least"), "shared-ids")
    if shared.df.isEmpty():
        return _classes(docs, sk.withColumn("id", F.col("doc_id")), key, text, similarity)
    # ids with several texts: all but one text go by an id of their own until the classes are named
    k, g, least = fresh(docs, "_key", "_shared", "_least")
    one = shared.small().select(F.col("doc_id").alias(g), F.col("least").alias(least))
    own = lambda i, row: F.when(row > F.col(least), F.xxhash64(i, row, F.lit("a text of its own"))).otherwise(i)
    renamed = docs.withColumn(k, F.col(key).cast("long")).join(one, F.col(k) == F.col(g), "left").withColumn(k, own(F.col(k), F.xxhash64(text)))
    sk = sk.join(one, F.col("doc_id") == F.col(g), "left").withColumn("id", own(F.col("doc_id"), F.col("row"))).drop(g, least)
    rows, links = _classes(renamed, sk, k, text, similarity)
    rows = stored(rows, "renamed-classes").df
    names = rows.groupBy("c").agg(F.min("doc_id").alias("name"))
    return rows.drop("class_id").join(stored(names, "class-names").small(), "c", "left").select("doc_id", "row", "words", "c", F.col("name").alias("class_id")), links


def _classes(docs: DataFrame, sk: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The classes by ``id``, which names one text (``key`` of ``docs``)."""
    nodes = stored(sk.where("k1 is not null").groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("sketch").alias("sketch"),
                                                                     F.first("bands").alias("bands")), "nodes").df
    named = nodes.where("node is not null")
    buckets = named.select("node", F.explode("bands").alias("band"))
    lead = buckets.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("band", "lead")
    pairs = stored(buckets.join(lead, "band").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), "pairs").df
    links = _verified(docs, pairs, key, text, similarity)
    roots = components(links)
    hidden = stored(_hidden_links(docs, named, buckets, roots, key, text, similarity), "hidden").df
    if not hidden.isEmpty():
        links = links.unionAll(hidden).dropDuplicates(["a", "b"])
        roots = components(links)
    copies = nodes.select("k1", "k2", "node").join(roots, "node", "left").select("k1", "k2", F.coalesce("root", "node").alias("root"))
    rows = sk.select("doc_id", "id", "row", "k1", "k2").join(copies, ["k1", "k2"], "left")
    name = F.coalesce("root", "id")
    return rows.select("doc_id", "row", F.col("k1").isNotNull().alias("words"), name.alias("c"), name.alias("class_id")), links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(classes, links): ``classes`` has one row per row of ``docs``: doc_id
    and class_id, the smallest doc_id of its class; ``links`` the verified
    pairs of different texts that join the classes (a > b, named by the
    smallest doc_id of each text) with their J_P."""
    rows, links = _rows(docs, key, text, similarity)
    return rows.select("doc_id", "class_id"), links


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the smallest doc_id's, and of
    several texts with that id one. Rows with a null doc_id stay; of rows with
    one doc_id and one text the first stays."""
    rows, _ = _rows(docs, key, text, similarity)
    rows = stored(rows, "classes").df
    g, r, w = fresh(docs, "_gone", "_row", "_twice")
    ids = rows.where("doc_id is not null")
    twice = stored(ids.groupBy(F.col("doc_id").alias(w)).agg(F.count("*").alias("n"), F.min("row").alias("least"), F.max("row").alias("most")).where("n > 1"), "twice")
    gone = ids.where("class_id < doc_id").select(F.col("doc_id").alias(g), F.col("row").alias(r))
    many = not twice.df.isEmpty()
    if many:  # several texts of one id may be one class
        same = ids.where("words and class_id = doc_id").join(twice.df.where("least <> most").select(F.col(w).alias("doc_id")), "doc_id", "left_semi")
        first = same.groupBy("doc_id", "c").agg(F.min("row").alias("first"))
        gone = gone.unionAll(same.join(first, ["doc_id", "c"]).where("row > first").select("doc_id", "row"))
    gone = stored(gone.distinct(), "gone")
    kept = docs.join(gone.small(), (F.col(key).cast("long") == F.col(g)) & (F.xxhash64(text) == F.col(r)), "left_anti")
    if not many:
        return kept
    repeated = stored(twice.df.select(w), "repeated")
    same = F.col(key).cast("long") == F.col(w)
    return kept.join(repeated.small(), same, "left_anti").unionAll(kept.join(repeated.small(), same, "left_semi").dropDuplicates([key, text]))
