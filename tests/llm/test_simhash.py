"""SimHash components against all pairs, and the fingerprint bit by bit."""

import random
import re

import pytest
import xxhash

from textguard.llm import catalog, simhash

from llm_rows import ODD, SF, documents


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> set of (doc_id, fingerprint, component_id)."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted(((d, f"{f:016x}", least.get(find(f))) for d, f in rows), key=repr)


def result(docs):
    return sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)


def test_fingerprint_bit_by_bit():
    texts = ["", " \n", "One", "ONE two", "one two three", "a b c a b c a b c", "Äpfel Ä ÄPFEL x\x1cy z", "word " * 3000, "\x0bvertical\x0cform feed\rline"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t), t


def test_fingerprint_in_slices(monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 31}" for i in range(2000))
    monkeypatch.setattr(simhash, "WORDS_AT_ONCE", 64)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_spark_hashes_the_same(spark):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([("one two three",), ("ä",)], "t string").select(F.xxhash64("t")).collect()
    for r, t in zip(got, ("one two three", "ä"), strict=True):
        assert r[0] % (1 << 64) == xxhash.xxh64_intdigest(t.encode(), 42)


def test_masks_cover_every_close_pair():
    """Whatever three bits differ, some mask of each level does not see them."""
    rng = random.Random(7)
    for _ in range(200):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        level = [0]
        for _depth in range(3):
            level = [c for m in level for c in simhash.split_bits(m) if not c & bits]
            assert level
        assert all(64 - m.bit_count() <= 9 and 1 << 9 == simhash.LEAF for m in level)


def test_query_against_all_pairs(spark, sample):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in sample.collect()]
    assert sorted(map(tuple, catalog.queries()["op12_simhash"](spark, SF).collect()), key=repr) == brute_components(docs)


def test_odd_rows(spark, odd, empty):
    assert result(odd) == brute_components([(d, brute_fingerprint(t)) for d, t in ODD])
    assert result(empty) == []


@pytest.mark.parametrize("leaf", [512, 40])
def test_dense_surroundings(spark, monkeypatch, leaf):
    """Fingerprints around two centres and a chain of links; with a small leaf
    the buckets are split again."""
    monkeypatch.setattr(simhash, "LEAF", leaf)
    rng = random.Random(3)
    fps = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(300):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    chain = rng.getrandbits(64)
    for b in range(0, 60, 3):
        chain ^= 7 << b
        fps.add(chain)
    rows = [(i, f) for i, f in enumerate(sorted(fps, key=lambda f: f * 0x9E3779B97F4A7C15 % (1 << 64)))]
    nodes = spark.createDataFrame([(simhash._signed(f),) for _, f in rows], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    got, want = {}, {}
    for d, f in rows:
        got.setdefault(root.get(simhash._signed(f), simhash._signed(f)), set()).add(d)
    for d, _f, c in brute_components(rows):
        want.setdefault(c, set()).add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_hot_template(spark):
    """Thousands of copies and near copies of one text, in one component each."""
    base = " ".join(f"token{i}" for i in range(400))
    texts = [base] * 300 + [f"{base} tail{i}" for i in range(300)] + [f"own {i} words {i * 7}" for i in range(50)] + [None] * 40
    rows = [(i, brute_fingerprint(t)) for i, t in enumerate(texts)]
    assert result(documents(spark, texts)) == brute_components(rows)
