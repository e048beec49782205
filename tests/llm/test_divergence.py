"""Source divergence against the definition, term by term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from textguard.llm import divergence

from llm_rows import documents


def brute(rows, ranks=200):
    """rows: (text, lang, source) -> the report's rows."""
    n, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        n[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted(t for t, c in seen[lang].items() if c >= 3)
        mine = sorted(s for x, s in groups if x == lang)
        total = Counter()
        for s in mine:
            total.update({t: n[lang, s][t] for t in kept})

        def p(counts, kept=kept):
            whole = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (whole + len(kept)) for t in kept}

        def f(a, b):
            return (a - b) ** 2 // b

        ps, q = {s: p(n[lang, s]) for s in mine}, p(total)
        for s in mine:
            pairs = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, f(ps[s][t], q[t])) for t in kept if n[lang, s][t] > 0 and ps[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:most])]
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus(n, langs, sources, words, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = min(int(rng.paretovariate(0.7)), 60)
        text = " ".join(f"w{chr(97 + rng.randint(0, 25))}{'x' * int(min(6, rng.paretovariate(1)))}{chr(97 + rng.randint(0, words))}" for _ in range(k))
        rows.append((text, f"l{i % langs}", "src0" if i % 3 else f"src{rng.randint(0, sources)}"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, len(r[0] or "")) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize(("block", "sources"), [(4096, 32), (16, 3)])
def test_report_by_definition(spark, block, sources):
    rows = corpus(400, 2, 8, 20) + [("", "l0", "none"), (None, None, None), ("Déjà DÉJÀ dÉjà", "l2", "one"), ("x1y_z É", "l2", "two")]
    audit = divergence.Audit(frame(spark, rows), block=block, sources=sources)
    assert result(audit.pair_rows().unionAll(audit.term_rows())) == brute(rows)


def test_few_ranks(spark):
    rows = corpus(200, 1, 3, 20)
    assert result(divergence.report(frame(spark, rows), ranks=5)) == brute(rows, 5)


def test_odd_rows(spark, odd, empty):
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert result(divergence.report(odd)) == brute(rows)
    assert result(divergence.report(empty)) == []


def test_copies_of_a_row_are_documents(spark):
    docs = documents(spark, [(1, "same words here")] * 6)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    got = result(divergence.report(docs))
    assert got == brute(rows) and any(r[2] == "pair" for r in got)


def test_long_texts_are_counted_in_slices(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 16)
    text = "Alpha beta-gamma " * 50 + "x" * 70 + " end" + "y" * 40
    for t in (text, text + " ", "", "  ", "z" * 100):
        words = [w for part in divergence._words(t.encode()) for w in part]
        assert words == [w.encode() for w in re.findall("[a-z]+", t.lower())]


def test_trees_share_equal_subtrees():
    counts = np.array([[1, 2, 0, 0, 1, 2, 0, 0], [0, 0, 0, 0, 1, 2, 0, 0]])
    root, levels = divergence.consed_trees(counts)
    left, right = levels[0]
    assert root[0] != root[1] and left[root[0]] == right[root[0]] == right[root[1]]
    assert [len(level[0]) for level in levels] == [2, 2, 2]
    t, a, b, m = divergence.walk_pairs(root, levels, 0, np.array([1]))
    assert sorted(zip(t.tolist(), a.tolist(), b.tolist(), m.tolist(), strict=True)) == [
        (1, 0, 0, 4), (1, 1, 0, 1), (1, 1, 1, 1), (1, 2, 0, 1), (1, 2, 2, 1)]


def test_counts_beyond_64_bits():
    assert divergence._shares(np.array([10**15]), 10**18, 7).tolist() == [1 + 10**9 * (10**15 + 1) // (10**18 + 7)]
