import hashlib
import random

import numpy as np
import pytest

from textguard.llm import suffix_dedup as S

from llm_rows import ODD, documents

LAST = 1 << 62


def brute(rows, m=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by sets of all m-byte strings."""
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        b = (t or "").encode()
        d = LAST if i is None else i
        mask = bytearray(len(b))
        for j in range(len(b) - m + 1):
            if seen.get(b[j:j + m], LAST) < d:
                mask[j:j + m] = b"\1" * m
        out.append((i, len(b), sum(mask), sum(1 for j in range(len(b)) if mask[j] and not (j and mask[j - 1])),
                    hashlib.sha256(bytes(x for x, k in zip(b, mask, strict=True) if not k)).hexdigest()))
        for j in range(len(b) - m + 1):
            seen[b[j:j + m]] = min(d, seen.get(b[j:j + m], LAST))
    return sorted(out, key=repr)


def report(df, **k):
    return sorted((tuple(r)[:5] for r in S.dedup_report(df, **k).collect()), key=repr)


def test_whole_sample(spark, sample):
    assert report(sample) == brute([(r.doc_id, r.text) for r in sample.collect()])


def test_random_repeats(spark, monkeypatch):
    rng = random.Random(5)
    parts = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 90))) for _ in range(12)] + ["a" * 200, "é" * 70, "\x00" * 60]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) for _ in range(60)]
    want = brute(list(enumerate(texts)))
    monkeypatch.setattr(S, "TEXT_PER_BUCKET", 3000)  # several buckets
    monkeypatch.setattr(S, "STRINGS_PER_BUCKET", 2000)
    df = documents(spark, texts).repartition(3)
    assert report(df) == want
    blocks = S.pack_blocks(df, block=900)
    assert blocks.count() > 10


def test_odd_rows(spark, odd, empty):
    rows = [(i, t if t is None or len(t) < 1000 else t) for i, t in ODD]
    got = report(odd)
    assert len(got) == len(rows)
    short = [r for r in got if r[1] < 1000]
    assert short == [r for r in brute([r for r in rows if len(r[1] or "") < 1000])]
    by_id = {r[0]: r for r in got}
    assert by_id[8][2] >= by_id[8][1] - 60 and by_id[8][3] == 1  # the long text stands in document 4
    assert by_id[4][2] == 0
    assert S.dedup_report(empty).count() == 0
    assert S.remove_repeats(empty, length="n_chars").columns == empty.columns


def test_remove_keeps_columns(spark, odd):
    df = documents(spark, ["x" * 10 + "passage of more than fifty bytes, which stands in two documents" + y for y in ("äöü", "éèê")], extra="block rows")
    out = {r.doc_id: r for r in S.remove_repeats(df, length="n_chars").collect()}
    assert out[1].text == "éèê" and out[1].n_chars == 3 and out[1].block == "x"
    assert S.remove_repeats(odd).columns == odd.columns and S.remove_repeats(odd).count() == odd.count()


def test_groups_hold_all_occurrences(spark):
    a, b = "the first passage that is longer than fifty bytes, certainly", "THE SECOND PASSAGE THAT IS LONGER THAN FIFTY BYTES, CERTAINLY"
    texts = [f"1{a}2", f"3{a}4{b}", f"5{b}6{a}", "7", f"8{b}"]
    rows = S.repeat_groups(documents(spark, texts)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.group, []).append(r)
    for g in groups.values():
        strings = {texts[r.doc_id].encode()[r.start:r.start + r.length] for r in g}
        assert len(strings) == 1 and all(r.n_places == len(g) for r in g)
    whole = lambda p: {d for d, t in enumerate(texts) if p in t}
    for p in (a, b):  # every document that holds the passage is in a group of it, covered whole
        covered = {d: set() for d in whole(p)}
        for r in rows:
            at = texts[r.doc_id].find(p)
            if at >= 0:
                covered[r.doc_id] |= set(range(r.start, r.start + r.length)) & set(range(at, at + len(p)))
        assert all(len(c) == len(p) for c in covered.values())


def test_groups_of_a_long_passage(spark):
    """Groups end at 84 bytes; together they cover a longer passage in every document, and nothing else."""
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage, texts, at = letters(600), [], []
    for i in range(3):
        before = letters(40 + i) + "ABC"[i]
        texts.append(before + passage + "ABC"[i] + letters(60))
        at.append(len(before))
    rows = S.repeat_groups(documents(spark, texts)).collect()
    assert max(r.length for r in rows) <= 2 * S.MIN_LEN - S.ANCHOR == 84
    said, held = {}, {}
    for r in rows:
        said.setdefault(r.group, set()).add(texts[r.doc_id][r.start:r.start + r.length])
        held.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    assert all(len(x) == 1 for x in said.values()) and all(r.n_places == 3 for r in rows)
    assert held == {i: set(range(a, a + 600)) for i, a in enumerate(at)}


def test_interval_tree_against_definition():
    rng = random.Random(1)
    for _ in range(100):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 40))) + b"$"
        data = np.frombuffer(s, np.uint8)
        starts = np.arange(len(s))
        order, lcp = S.suffix_array(data, starts, len(s) - starts, len(s))
        assert [s[i:] for i in starts[order]] == sorted(s[i:] for i in starts)
        left = np.where(starts[order] > 0, data[starts[order] - 1].astype(int), 256)
        lo, hi, depth = S.interval_tree(lcp, left, 2)
        got = {(s[starts[order][a]:starts[order][a] + d], b - a + 1) for a, b, d in zip(lo, hi, depth, strict=True)}
        want = set()
        for i in range(len(s)):
            for j in range(i + 2, len(s)):
                w = s[i:j]
                at = [k for k in range(len(s)) if s[k:k + len(w)] == w]
                right = {s[k + len(w):k + len(w) + 1] for k in at}
                before = {s[k - 1:k] if k else k - 1 for k in at}
                if len(at) > 1 and len(right) > 1 and (len(before) > 1):
                    want.add((w, len(at)))
        assert got == want


@pytest.mark.parametrize("n", [0, 1, 49, 50, 51])
def test_lengths_around_the_minimum(spark, n):
    t = "".join(chr(97 + i % 26) for i in range(n))
    assert report(documents(spark, [t, t])) == brute([(0, t), (1, t)])
