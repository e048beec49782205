"""Lexicons of thousands of terms against one term after the other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textguard.functions import predicates as P
from textguard.functions import terms as X
from textguard.functions import text as T

from one_column import one_col

LETTERS = "abcdeоЖжßſıİςΣσ.𝔘(*"


def words(rng, n, letters, longest):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize(("n", "letters", "longest"), [(120, LETTERS, 4), (300, "ab", 7), (5000, "abcdefghij", 5)])
def test_deletes_as_one_after_the_other(spark, n, letters, longest):
    rng = random.Random(n)
    terms = words(rng, n, letters, longest)
    if letters == "ab":  # few short ones, or nothing is left to differ
        terms = [t for t in terms if len(t) > 3] + ["ab"]
    texts = ["".join(rng.choice(letters + " AB") for _ in range(rng.randint(0, 70))) for _ in range(300 if n < 1000 else 60)] + [None, ""]
    got = one_col(spark, texts, lambda c: X.delete_in_order(c, terms))
    if n < 1000:
        want = texts
        for lo in range(0, len(terms), 40):  # a plan of all of them is too large to compile
            want = one_col(spark, want, lambda c, lo=lo: T.reduce(lambda acc, t: F.regexp_replace(acc, T.literal_pattern(t), ""), terms[lo:lo + 40], c))
    else:
        want = []
        for t in texts:
            for w in terms if t else ():
                t = re.sub(re.escape(w), "", t, flags=re.IGNORECASE)
            want.append(t)
    assert got == want


def test_joined_and_broken_occurrences(spark):
    cases = {  # terms -> text, what is left
        ("bad", "xyz", "catt"): ("xbadyz", ""), ("xyz", "bad"): ("xbadyz", "xyz"), ("nice", "oran"): ("oranice", "ora"), ("oran", "nice"): ("oranice", "ice"),
        ("ab", "cd", "ab"): ("acdb aabb", " "), ("aa",): ("aaa AaA", "a A"), ("abc", "ab", "a"): ("abcabca", ""),
        ("b", "c", "ad"): ("abcd abd", " ")}
    for terms, (text, left) in cases.items():
        assert one_col(spark, [text], lambda c, t=terms: X.delete_in_order(c, t)) == [left], terms


def test_hits_equal_a_search_per_term(spark):
    rng = random.Random(5)
    terms = words(rng, 5000, "abcdefghijklm", 6)
    terms += terms[:50] + ["", "UPPER"]
    texts = ["".join(rng.choice("abcdefghijklmABC ") for _ in range(rng.randint(0, 80))) for _ in range(200)] + [None, "", "𝔘a"]
    want = [0 if t is None else sum(w in t.lower() for w in terms) for t in texts]
    assert one_col(spark, texts, lambda c: P.term_hits(c, terms)) == want
    plan = spark.createDataFrame([("x",)], "t string").select(P.term_hits("t", terms).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=(") == len(X.prefix_layers([t for t in terms if t])) <= 6


def test_layers_and_tree():
    layers = X.prefix_layers(["a", "ab", "abc", "b", "ab", "bc"])
    assert layers == [["a", "b"], ["ab", "bc"], ["abc"]]
    for layer in layers:
        assert not any(x != y and y.startswith(x) for x in layer for y in layer)
    p = re.compile(X.tree_pattern(["oran", "orantion", "in.", "i", "x" * 3000]))
    assert [p.match(t)[0] for t in ("orantion", "orant", "in.", "inx", "x" * 3001)] == ["orantion", "oran", "in.", "i", "x" * 3000]


def test_cleanse_with_a_long_list(spark):
    terms = [f"term{i}x" for i in range(3000)]
    texts = ["keep  Term12X this", "nothing", "tterm1xerm5x", None]
    assert one_col(spark, texts, lambda c: T.cleanse(c, terms, [r"k\w+p"])) == ["this", "nothing", "", None]
