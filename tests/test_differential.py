"""Differential tests: Spark expressions vs Python's own string functions,
and properties of the composed ones, on seeded random strings (Latin, Cyrillic, extended Cyrillic letters, digits,
emoji with ZWJ / skin tones, quotes, exotic spaces, line breaks)."""

import random
import re

import pytest

from textguard.functions import predicates as P
from textguard.functions import text as T

ALPHABET = (list("abcxyzABCXYZ") + list("абвгдеӘәҗңөүһ") + list("0123_-.,!?;:()\"'")
            + [" ", " ", "\t", "\n", "\r\n", " ", " ", "\x1c", "\x1e", "‍", "👍", "🏽", "👨"]
            + ["ab", "abc", "АБВ", "hate", "Hate", "!!!", "...", "??"])
TERMS = ["ab", "abc", "абв", "hate", "ә"]
N = 400


def gen(seed, n=N, max_len=25):
    rnd = random.Random(seed)
    return [None if i == 0 else "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, max_len)))
            for i in range(n)]


@pytest.fixture(scope="module")
def texts():
    return gen(7)


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def run(frame, expr):
    return [r["o"] for r in frame.select("i", expr.alias("o")).orderBy("i").collect()]


def py_remove_literals(t):
    if t is None:
        return None
    for term in TERMS:
        t = re.sub(re.escape(term), "", t, flags=re.IGNORECASE)
    return t


def py_collapse(t):
    return None if t is None else re.sub(r"\s+", " ", t).strip()


def py_drop_latin(t):
    if t is None:
        return ""
    return " ".join(w for w in t.split() if not re.search(r"[A-Za-z]", w))


def py_is_blank(t):
    return t is None or t.strip() == ""


def py_hits(t):
    return 0 if t is None else sum(1 for x in TERMS if x in t.lower())


def py_pattern(t):
    return None if t is None else re.sub(r"\bab\w*|х\s*у", "", t, flags=re.IGNORECASE)


CASES = [
    ("remove_literals", lambda: T.remove_literals("t", TERMS), py_remove_literals),
    ("collapse_ws", lambda: T.collapse_ws("t"), py_collapse),
    ("drop_latin", lambda: T.drop_tokens_matching("t"), py_drop_latin),
    ("is_blank", lambda: P.is_blank("t"), py_is_blank),
    ("term_hits", lambda: P.term_hits("t", TERMS), py_hits),
    ("patterns", lambda: T.remove_patterns("t", [r"\bab\w*|х\s*у"]), py_pattern),
    ("split_ws", lambda: T.split_ws("t"), lambda t: None if t is None else t.split()),
]


@pytest.mark.parametrize("name,spark_fn,py_fn", CASES, ids=[c[0] for c in CASES])
def test_matches_python(frame, texts, name, spark_fn, py_fn):
    got = run(frame, spark_fn())
    want = [py_fn(t) for t in texts]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not bad, f"{name}: {len(bad)} differ, e.g. {bad[:3]!r}"


# properties of the composed functions, on the same random texts

def test_normalize_punct_properties(frame, texts):
    got = run(frame, T.normalize_punct("t"))
    again = run(frame.sparkSession.createDataFrame(list(enumerate(got)), "i int, t string"), T.normalize_punct("t"))
    for t, g, a in zip(texts, got, again):
        assert (g is None) == (t is None)
        if g is not None:
            if not re.search(r"\s[!?.]", t):  # marks that only meet once the space between them goes stay
                assert "!!!" not in g and "???" not in g and "...." not in g and a == g
            assert g == g.strip() and "  " not in g and not re.search(r"\s[,.!?;:]", g)
            assert [c for c in g if c.isalnum()] == [c for c in t if c.isalnum()]


def test_normalize_punct_rows(spark):
    rows = {"a!!!!": "a!!", "a!!": "a!!", "b????": "b??", "c.....": "c...", "d ,e": "d,e", " x \t y ": "x y", "a !!! ?": "a!!?", "": ""}
    f = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert run(f, T.normalize_punct("t")) == list(rows.values())


def test_first_line_properties(frame, texts):
    for t, g in zip(texts, run(frame, T.extract_first_line("t"))):
        assert g == g.strip() and len(g.splitlines()) <= 1
        assert g in (t or "")


def test_first_line_rows(spark):
    rows = {"one\ntwo": "one", "  \n  three  ": "three", '"quoted"\nx': "quoted", '"': '"', "": "", " \t": ""}
    for p in T.ANSWER_PREFIXES:
        rows[p + " answer\nmore"] = "answer"
        rows[p.upper() + " answer"] = "answer"
    f = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert run(f, T.extract_first_line("t")) == list(rows.values())


def test_filter_tokens_properties(frame, texts):
    got = run(frame, T.filter_tokens("t", TERMS, []))
    again = run(frame.sparkSession.createDataFrame(list(enumerate(got)), "i int, t string"), T.filter_tokens("t", TERMS, []))
    assert again == got
    for t, g in zip(texts, got):
        if t:
            words = iter(t.split())
            assert all(w in words for w in g.split())  # what stays keeps its order
            for w in g.split():
                bare = w.lower().strip(T.TOKEN_PUNCT)
                assert bare not in TERMS and "hate" not in bare
