import zlib
from collections import Counter

import numpy as np

from textguard.llm import repair_tokens as R
from textguard.llm.tokens import TOKENIZER, tokenizer

from llm_rows import ODD, documents


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(1, 40, rng.integers(1, 6))
        ids, at = rng.integers(0, 4, n.sum()).astype(np.uint32), np.cumsum(n) - n
        seq, begin, rules = R.compress(ids, at, 50, 4, 3, 2)
        assert (R.expand(seq, rules, 50) == ids).all()
        lengths, ends = R.expansion_lengths(rules, 50), [*begin[1:], len(seq)]
        assert all(len(R.expand(np.array([50 + r], np.uint32), rules, 50)) == m for r, m in enumerate(lengths.tolist()))
        for j in range(len(n)):
            mine = ids[at[j]:at[j] + n[j]]
            lo = int(rng.integers(0, n[j]))
            hi = int(rng.integers(lo, n[j])) + 1
            assert (R.decode_range(seq[begin[j]:ends[j]], rules, lengths, 50, lo, hi) == mine[lo:hi]).all()


def test_frequent_pairs_become_rules():
    ids = np.tile(np.array([7, 8, 9, 10], np.uint32), 100)
    seq, _, rules = R.compress(ids, np.array([0]), 50)
    assert len(seq) < 30 and len(rules)


def test_no_frequent_pair_is_left():
    """A passage that stands often is a symbol or two; also copies end to end and runs of one id."""
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50, 1000)
    docs = [np.concatenate((rng.integers(0, 50, rng.integers(1, 20)), passage, rng.integers(0, 50, 5))) for _ in range(200)]
    docs += [np.tile(passage[:7], 400), np.full(5000, 3), rng.integers(0, 50, 3000)]
    n = np.array([len(d) for d in docs])
    ids, at = np.concatenate(docs).astype(np.uint32), np.cumsum(n) - n
    seq, begin, rules = R.compress(ids, at, 50)
    lengths = R.expansion_lengths(rules, 50)
    assert (R.expand_all(seq, rules, lengths, 50) == ids).all()
    ends = [*begin[1:], len(seq)]
    assert [len(R.expand(seq[a:b], rules, 50)) for a, b in zip(begin, ends, strict=True)] == n.tolist()
    pairs = [p for a, b in zip(begin.tolist(), ends, strict=True) for p in zip(seq[a:b - 1].tolist(), seq[a + 1:b].tolist(), strict=True)]
    assert max(Counter(pairs).values()) < R.MIN_COUNT
    assert np.median(np.diff([*begin[:201]])) < 40 and lengths.max() > 900


def expected(rows):
    t, at, out = tokenizer(TOKENIZER), 0, []
    for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_files_round_trip(spark, sample, tmp_path):
    R.write(sample.repartition(5), str(tmp_path / "t"), shard_ids=5000)
    got = [tuple(r) for r in R.read(spark, str(tmp_path / "t")).orderBy("start").collect()]
    assert got == expected([(r.doc_id, r.text) for r in sample.collect()])
    assert spark.read.parquet(str(tmp_path / "t")).count() > 5
    first = sample.orderBy("doc_id").first()
    ids = tokenizer(TOKENIZER).encode(first.text, add_special_tokens=False).ids + [2]
    assert R.read_document(spark, str(tmp_path / "t"), first.doc_id) == [ids]
    assert R.read_document(spark, str(tmp_path / "t"), first.doc_id, 3, 9) == [ids[3:9]]
    assert R.read_document(spark, str(tmp_path / "t"), -5) == []


def test_odd_rows(spark, odd, empty):
    got = sorted((tuple(r) for r in R.write_and_read(odd).collect()), key=lambda r: r[1])
    assert got == expected([(i, t or "") for i, t in ODD]) or [r[1:3] for r in got] == [r[1:3] for r in expected(ODD)]
    assert R.write_and_read(empty).count() == 0


def test_ids_come_back(spark):
    df = documents(spark, ["some words here", None])
    import tempfile
    path = tempfile.mkdtemp(prefix="run-") + "/f"
    R.write(df, path)
    rows = {r.doc_id: r.ids for r in R.read(spark, path, with_ids=True).collect()}
    assert rows[1] == [2] and rows[0][-1] == 2 and len(rows[0]) == 4


def test_words_are_one_word_with_and_without_the_sign_after_them(monkeypatch):
    """The library's merges meet the letters once, and all ids are as of the whole text."""
    import pyarrow as pa

    from textguard.llm.tokens import Encoder
    enc, asked = Encoder(TOKENIZER), []
    ids = enc._ids
    monkeypatch.setattr(enc, "_ids", lambda texts: [asked.append(t) or i for t, i in zip(texts, ids(texts), strict=True)])
    texts = ["x wrenlod wrenlod, wrenlod.\nWrenlod wrenlod's wrenlod$$$ wrenlod!", "x qué, qué. qu×. ², 中. a1, a_b. ,a İ. é, éͅ.", "x " + "a," + "b" * 60 + " a," + "b" * 30, "", "x  a,  b,", "<|endoftext|>a, a."]
    got, off = enc.encode(pa.array(texts))
    assert [got[a:b].tolist() for a, b in zip(off, off[1:])] == [e.ids for e in tokenizer(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    assert sum(t.count("wrenlod") for t in asked) == 2  # with a space before it: alone, and in the word with an apostrophe
