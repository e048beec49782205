"""Findings of the third round: less work for the same rows."""

import random
import re

from one_column import one_col
from pyspark.sql import functions as F

from textguard.functions import lexicon as L
from textguard.functions import regex as X
from textguard.functions import terms as TE
from textguard.functions import text as T
from textguard.operators import caches as C
from textguard.operators import gate as G
from textguard.operators import select as SEL
from textguard.session import prepare

PIECES = ["oran", "the", "ononst", "tion", "a", "b.", " ", "  ", "\n", "é", "_", "9", "ORAN", "The", "Я", "!!!!", ",", "\u200a", "\x85", "ſ", "K"]


def some_texts(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)] + [None, "", " ", "tion", "tiontion"]


def spans(rx, texts):
    return [None if t is None else re.sub(rx, "<>", t, flags=re.I) for t in texts]


def test_word_edges_and_leading_runs_match_as_before(spark):
    texts = some_texts(1)
    patterns = [r"\bthe\b", r"\boran\w*", r"\w*oran\w*", r"(\w+)tion\b", r"\w+a", r"\b", r"\ba?", r"\x2e\b", r"\w*", r"\bononst\b[^.]*\."]
    for p in patterns:
        assert one_col(spark, texts, lambda c, p=p: F.regexp_replace(c, T.java_pattern(p), "<>")) == spans(p, texts), p
    assert X.BOUNDARY not in X.python_regex_to_java(r"\bthe\b") and X.BOUNDARY in X.python_regex_to_java(r"\b\w")


def test_rule_chain_is_built_once(spark):
    rules = [(r"\boran\b", ""), (r"tion\b", "ce")]
    texts = some_texts(2)
    plan = spark.createDataFrame([("x",)], "t string").select(T.rule_clean("t", rules, rules[:1]).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ce, 1") == 1
    assert one_col(spark, ["oran", "oran tion x", None, "  "], lambda c: T.rule_clean(c, rules, rules[:1])) == ["oran", "ce x", "", ""]
    want = []
    for t in texts:
        row, now = [], t
        for p, r in rules:
            row.append((t is not None and bool(re.search(p, t, re.I)), now is not None and bool(re.search(p, now, re.I))))
            now = None if now is None else re.sub(p, r, now, flags=re.I)
        want.append(row)
    assert [[tuple(x) for x in r] for r in one_col(spark, texts, lambda c: L.rule_hits(c, rules))] == want
    rules_plan = spark.createDataFrame([("x",)], "t string").select(L.rule_hits("t", rules))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in rules_plan  # a fold compiles each pattern anew for each row


def test_attempts_after_the_stop_are_not_prepared(spark, monkeypatch):
    real = SEL.prepare_attempt
    monkeypatch.setattr(SEL, "prepare_attempt", lambda raw, *a: real(F.when(raw == "late", F.raise_error(F.lit("prepared")).cast("string")).otherwise(raw), *a))
    df = spark.createDataFrame([(["good words here", "late"], "good words here")], "a array<string>, s string")
    assert df.select(SEL.best_of_n("a", "s", ["oran"]).alias("o")).first().o == "good words here"


def test_texts_without_a_term_skip_the_token_filter(spark):
    terms, replacements = ["oran", "ti", "the"], [("oran", "x")]
    texts = some_texts(3)

    def key(w):
        return w.lower().strip(T.TOKEN_PUNCT)

    def by_hand(t, aggressive):
        if t is None or (t == "" and not aggressive):
            return t
        out = []
        for w in t.split():
            k = key(w)
            if k in terms or (aggressive and "oran" in k):
                continue
            out.append("x" if "oran" in k else w)
        return (t if aggressive and not out else " ".join(out))
    assert one_col(spark, texts, lambda c: T.filter_tokens(c, terms, replacements)) == [by_hand(t, False) for t in texts]
    assert one_col(spark, texts, lambda c: T.drop_toxic_tokens(c, terms)) == [by_hand(t, True) for t in texts]
    assert one_col(spark, texts, lambda c: TE.count_hits(F.lower(c), [*terms, "the", ""])) == [0 if t is None else sum(x in t.lower() for x in [*terms, "the", ""]) for t in texts]
    said = ["a A a b", "a a", "b b B b", None, "", " x  X\nx y"]
    assert one_col(spark, said, T.keep_two_repeats) == ["a A b", "a a", "b b", None, "", "x X y"]
    assert one_col(spark, texts, T.strip_ws) == [None if t is None else t.strip() for t in texts]
    assert one_col(spark, texts, T.is_blank) == [t is None or not t.strip() for t in texts]
    plan = spark.createDataFrame([("x",)], "t string").select(T.filter_tokens("t", terms))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("contains(") >= 4  # the text is looked through before its words are


def test_many_branches_are_halved():
    terms = [a + b + "x" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abc"]
    p = TE.tree_pattern(terms)
    assert "(?=[a-m])" in p
    assert all(re.fullmatch(p, t) for t in terms) and not re.match(p, "adx") and re.match(p, "ZCX", re.I)


def test_rows_that_are_not_gated_are_not_shuffled(spark):
    import uuid
    cache = C.BucketedCache(spark, f"cache_{uuid.uuid4().hex[:10]}", 4)

    def up():
        return lambda xs: [None if x == "none" else x.upper() for x in xs]
    df = spark.createDataFrame([(1, "a", True), (1, "a", True), (None, "b", False), (3, None, True), (4, "none", True), (5, None, None)], "k int, t string, g boolean")
    try:
        for _ in range(2):
            out = C.cached_stages(df, "g", "t", "o", [("up", up), ("up2", up)], {"up": cache, "up2": cache})
            assert sorted(map(str, out.select("k", "t", "o").collect())) == sorted(map(str, [
                (1, "a", "A"), (1, "a", "A"), (None, "b", "b"), (3, None, None), (4, "none", None), (5, None, None)])) or \
                {tuple(r) for r in out.select("k", "t", "o").collect()} == {(1, "a", "A"), (None, "b", "b"), (3, None, None), (4, "none", None), (5, None, None)}
            assert out.count() == 6 and out.columns == ["k", "t", "g", "o"]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Union" in plan
        assert cache.read().count() == 2  # a, A; no null answer
    finally:
        cache.drop()


def test_batches_are_bounded_by_bytes(spark):
    from textguard.session import ARROW_BATCH_BYTES
    prepare(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == ARROW_BATCH_BYTES
    df = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 10000).alias("t"))
    out = G.batch_map(df, lambda: lambda xs: [str(len(xs))] * len(xs), "t", "n", batch_size=1 << 20)
    assert max(int(r.n) for r in out.select("n").distinct().collect()) * 10000 <= 2 * ARROW_BATCH_BYTES
