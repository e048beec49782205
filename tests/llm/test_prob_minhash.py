import random
from collections import Counter

import numpy as np

from textguard.llm import prob_minhash as P
from textguard.llm.common import shingle_hashes, word_hashes

from llm_rows import documents


def bag(text):
    w = text.lower().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jp(a, b):
    return sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in set(a) | set(b)) for x in a if x in b)


def brute_classes(rows):
    bags = {i: bag(t or "") for i, t in rows}
    up = {i: i for i in bags}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in bags:
        for b in bags:
            if b < a and bags[a] and bags[b] and jp(bags[a], bags[b]) >= P.SIMILARITY - 1e-12:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def near_copies(rng, n, words, edits):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_probability_jaccard_matches_definition():
    rng = random.Random(2)
    for _ in range(200):
        a = Counter(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
        b = Counter(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
        f = lambda c: tuple(np.array(x) for x in zip(*sorted((ord(k), v) for k, v in c.items()), strict=True))
        assert abs(P.probability_jaccard(f(a), f(b)) - jp(a, b)) < 1e-9


def test_sketch_estimates_probability_jaccard():
    rng = np.random.default_rng(0)
    keys = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 250), rng.integers(1, 6, 250)
    doc = np.repeat([0, 1], 250)
    sk = P.prob_minhash(doc, np.concatenate((keys[:250], keys[50:])), np.concatenate((wa, wb)), 2, slots=4096)
    exact = P.probability_jaccard(*[(lambda k, w: (np.sort(k), w[np.argsort(k)]))(k, w) for k, w in ((keys[:250], wa), (keys[50:], wb))])
    assert abs((sk[0] == sk[1]).mean() - exact) < 0.04


def test_word_and_shingle_hashes():
    t = "a bb  ccc\ta bb\n é"
    h = word_hashes(t.encode())
    assert len(h) == 6 and h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 4
    assert len(word_hashes(b"")) == len(word_hashes(b" \n ")) == 0
    assert len(shingle_hashes(h[:3])) == 1 and len(shingle_hashes(h)) == 2 and len(shingle_hashes(h[:0])) == 0


def test_classes_against_brute_force(spark, sample):
    got = {r.doc_id: r.class_id for r in P.near_duplicates(sample)[0].collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in sample.collect()])


def test_chains_in_large_buckets(spark, monkeypatch):
    """Texts around the threshold whose links avoid the bucket's smallest node."""
    monkeypatch.setattr(P, "CHUNK", 4)
    rng = random.Random(9)
    texts = near_copies(rng, 40, 120, 3) + near_copies(rng, 25, 200, 5) + [" ".join(f"z{rng.randint(0, 999)}" for _ in range(50)) for _ in range(10)]
    rng.shuffle(texts)
    got = {r.doc_id: r.class_id for r in P.near_duplicates(documents(spark, texts))[0].collect()}
    assert got == brute_classes(list(enumerate(texts)))


def test_a_text_of_a_shared_id_is_not_lost(spark):
    words = lambda c: " ".join(f"{c}{i}" for i in range(30))
    x, y, z = words("x"), words("y"), words("z")
    docs = documents(spark, [(3, x), (6, x), (6, y), (6, z), (7, y), (8, None), (8, z + " more")])
    classes = sorted((r.doc_id, r.class_id) for r in P.near_duplicates(docs)[0].collect())
    assert classes == [(3, 3), (6, 3), (6, 6), (6, 6), (7, 6), (8, 6), (8, 8)]
    kept = sorted((r.doc_id, r.text or "") for r in P.keep_first(docs).collect())
    assert kept == [(3, x), (6, y), (6, z), (8, "")]
    # two near copies under one id are one class, of which one stays
    docs = documents(spark, [(4, x), (4, x + " tail"), (5, y)])
    assert len(P.keep_first(docs).collect()) == 2


def test_odd_rows(spark, odd, empty):
    rows = P.near_duplicates(odd)[0].collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r.class_id for r in rows}
    assert by[2] == 2 and by[3] == 3 and by[1] == 1 and by[8] == 4 and by[5] == 5
    kept = P.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 6, 7, 9] and ids.count(None) == 2
    assert P.near_duplicates(empty)[0].count() == 0 and P.keep_first(empty).count() == 0
