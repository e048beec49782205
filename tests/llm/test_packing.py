import random
import zlib

import numpy as np
import pyarrow as pa

from textguard.llm import packing as P
from textguard.llm.tokens import TOKENIZER, Encoder, tokenizer

from llm_rows import ODD, documents


def test_encoder_equals_the_library():
    t, e, rng = tokenizer(TOKENIZER), Encoder(), random.Random(1)
    letters = " \n\t\r\x1c\x85\xa0 ​　aB1é's.,!日\x00𝔘<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["", " ", "x" * 5000, "a  b   c    d"]
    for lo in range(0, len(texts), 500):
        part = texts[lo:lo + 500]
        ids, off = e.encode(pa.array(part))
        for i, s in enumerate(part):
            assert t.encode(s, add_special_tokens=False).ids == ids[off[i]:off[i + 1]].tolist(), repr(s)


def test_added_tokens_in_a_text():
    """The ids are those of the plain library, whatever the texts around."""
    import public_tokenizers
    from tokenizers import Tokenizer
    t, e = Tokenizer.from_file(public_tokenizers.path(TOKENIZER)), Encoder()
    end = "<|endoftext|>"
    texts = ["see here", f"see {end} here", end, f"{end}{end} a  b", "", f"a{end}b", f"x \n {end}", "see here  again", "<|endoftext"]
    ids, off = e.encode(pa.array(texts))
    for i, s in enumerate(texts):
        assert t.encode(s, add_special_tokens=False).ids == ids[off[i]:off[i + 1]].tolist(), repr(s)
    assert e.encode(pa.array(texts[1:2]))[0].tolist() == [3826, 220, 50256, 994]


def test_cut():
    assert P.cut(5, 10) == [(0, 5)] and P.cut(10, 10) == [(0, 10)]
    assert P.cut(25, 10) == [(0, 5), (5, 10), (15, 10)] and P.cut(20, 10) == [(0, 10), (10, 10)]


def test_bins_hold_everything():
    rng = random.Random(3)
    for _ in range(200):
        room = rng.choice([10, 50, 2048])
        sizes = [rng.randint(1, room - 1) for _ in range(rng.randint(0, 60))]
        first = P.best_fit(sizes, room)
        best = P.local_search([list(b) for b in first], sizes, room)
        assert sorted(i for b in best for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= room for b in best) and len(best) <= len(first)


def test_local_search_empties_bins():
    sizes = [6, 4, 5, 5, 4, 6]
    assert len(P.local_search([[0], [1, 2], [3, 4], [5]], sizes, 10)) == 3
    assert len(P.local_search([[0, 1], [2], [3]], [7, 2, 5, 5], 10)) == 2  # a move


def check(rows, texts, room=P.LENGTH):
    t = tokenizer(TOKENIZER)
    want = sorted(np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for x in texts)
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= room
    assert sum(r.length for r in rows) == sum(len(w) // 4 for w in want)
    return by_doc, by_seq, want


def test_sample(spark, sample):
    texts = {r.doc_id: r.text for r in sample.collect()}
    rows = P.pack_documents(sample).collect()
    by_doc, by_seq, _ = check(rows, texts.values())
    t = tokenizer(TOKENIZER)
    for i, x in texts.items():
        ids, at = np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4"), 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            assert r.length == P.LENGTH or k == 0
            at += r.length
    least = -(-sum(r.length for r in rows) // P.LENGTH)
    assert len(by_seq) <= least * 1.02 + 1


def test_several_groups(spark):
    rng = random.Random(7)
    texts = [" ".join("word" for _ in range(rng.randint(1, 1500))) for _ in range(600)]
    rows = P.pack(P.pieces(documents(spark, texts)), group=100).collect()
    _, by_seq, _ = check(rows, texts)
    assert len(by_seq) <= -(-sum(r.length for r in rows) // P.LENGTH) * 1.05 + 2


def test_sequences_hold_the_ids(spark, sample):
    rows = P.sequences(sample).collect()
    assert all(len(r.ids) <= P.LENGTH for r in rows) and sum(r.ids.count(0) >= 1 for r in rows)


def test_odd_rows(spark, odd, empty):
    rows = P.pack_documents(odd).collect()
    check(rows, [t for _, t in ODD])
    assert P.pack_documents(empty).count() == 0
