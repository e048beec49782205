"""Hand-worked rows for the text operators (FIXTURES.md part C)."""

from pyspark.sql import functions as F

from one_column import one_col
from textguard.functions import predicates as P
from textguard.functions import text as T


def test_ordered_deletion(spark):
    got = one_col(spark, ["abcx", "aabbc", "ABCX", "ПРИВЕТ мир", "x👍🏽y", "a👨‍👩‍👧b"],
                  lambda c: T.remove_literals(c, ["ab", "abc", "привет", "👍🏽", "👨‍👩‍👧"]))
    # 'abc' never matches in 'abcx': 'ab' goes first; 'aabbc' -> 'abc' -> '' (deletion joins a new match)
    assert got == ["cx", "", "CX", " мир", "xy", "ab"]


def test_word_edges_regex(spark):
    texts = ["foo bar", "barfoo", "foo_x", "foo1", "x-foo", "foo‍x", "xfoox"]
    got = one_col(spark, texts, lambda c: T.remove_patterns(c, [r"\bfoo\b"]))
    # '_' and digits are word chars; '-' and U+200D are not (Python's \w)
    assert got == [" bar", "barfoo", "foo_x", "foo1", "x-", "‍x", "xfoox"]


def test_stem_pattern_unicode(spark):
    got = one_col(spark, ["Ахмак булдың", "ахмаклар", "x ахмакъ y"], lambda c: T.remove_patterns(c, [r"ахмак\w*"]))
    assert got == [" булдың", "", "x  y"]


def test_whitespace(spark):
    got = one_col(spark, ["a\tb", "a\r\nb", "a b", "a\x1cb", "  a  ", None, ""], T.collapse_ws)
    assert got == ["a b", "a b", "a b", "a b", "a", None, ""]


def test_blank(spark):
    got = one_col(spark, [None, "", "  ", " \x1d", "x"], P.is_blank)
    assert got == [True, True, True, True, False]


def test_punctuation(spark):
    got = one_col(spark, ["wow!!!!", "what??", "hm....", "a , b", "x !!! ?? ... ,"], T.normalize_punct)
    assert got == ["wow!!", "what??", "hm...", "a, b", "x!!??...,"]


def test_rule_ladder(spark):
    rules = [(r"\bbad\w*", ""), (r"\bworse\b", "")]
    fb = rules[:1]
    texts = ["bad", "badly worse", "ok bad", None, "   ", "x", "bad!!!"]
    got = one_col(spark, texts, lambda c: T.rule_clean(c, rules, fb))
    # 'bad': empty after all rules, the light rules leave nothing either -> source;
    # 'badly worse': empty after all rules -> light rules leave 'worse'
    assert got == ["bad", "worse", "ok", "", "", "x", "!!"]


def test_rule_ladder_light_result(spark):
    rules = [(r"\bfoo\b", ""), (r"\bbar\b", ""), (r"z", "")]
    fb = rules[:1]
    got = one_col(spark, ["foo bar z"], lambda c: T.rule_clean(c, rules, fb))
    assert got == ["bar z"]


def test_filter_tokens(spark):
    terms = ["bad", "awful", "hate"]
    reps = [("awf", "meh"), ("hat", "")]
    texts = ["Bad! day", "so awfully good", "hateful thing", "(bad) x", "fine words", "", None]
    got = one_col(spark, texts, lambda c: T.filter_tokens(c, terms, reps))
    # exact term dropped; 'awfully' contains 'awful' (len>3) -> first key 'awf' -> 'meh';
    # 'hateful' contains 'hate' -> key 'hat' with empty replacement -> dropped
    assert got == ["day", "so meh good", "thing", "x", "fine words", "", None]


def test_filter_tokens_short_terms_not_contained(spark):
    got = one_col(spark, ["abcd abc abcde"], lambda c: T.filter_tokens(c, ["abc", "abcd"], []))
    assert got == [""]
    got = one_col(spark, ["xabcx"], lambda c: T.filter_tokens(c, ["abc"], []))
    assert got == ["xabcx"]  # a 3-char term only matches exactly


def test_drop_toxic_tokens(spark):
    got = one_col(spark, ["bad awfully ok", "bad", "   "], lambda c: T.drop_toxic_tokens(c, ["bad", "awful"]))
    assert got == ["ok", "bad", "   "]


def test_drop_latin(spark):
    got = one_col(spark, ["Сәлам hello мир1 x2", None, "abc"], T.drop_tokens_matching)
    assert got == ["Сәлам мир1", "", ""]


def test_extract_marked_answer(spark):
    rows = ["no marker\nlast line", "x\nDetoxed: final", "Detoxed: a\n(Translation: b)\nanswer",
            "Detoxed: one\nDetoxed: two\nz", "   ", '"Detoxed:assistant quoted"', None,
            "Detoxed: a\n(Translation x)"]
    got = one_col(spark, rows, T.extract_marked_answer)
    assert got == ["last line", "final", "answer", "z", "", "quoted", "", "a"]


def test_extract_first_line(spark):
    rows = ["Assistant: hi\nmore", "ASSISTANT:: x", "answer 42", '"quoted"', "Җавап: яхшы", "   ", None,
            "detoxed", '"']
    got = one_col(spark, rows, T.extract_first_line)
    assert got == ["hi", "x", "42", "quoted", "яхшы", "", "", "", '"']


def test_keep_two_repeats(spark):
    got = one_col(spark, ["a a a a b A a", "x X x x", "one"], T.keep_two_repeats)
    assert got == ["a a b A a", "x X", "one"]


def test_clean_generated(spark):
    df = spark.createDataFrame([(1, "PROMPT: hi there\nhi there", "src"), (2, "\n\n", "src"),
                                (3, '"ab"\n"long enough"', "src"), (4, "", "src"),
                                (5, "go go go go now", "src")], "i int, g string, s string")
    got = [r["o"] for r in df.select("i", T.clean_generated("g", "s", "PROMPT:").alias("o")).orderBy("i").collect()]
    assert got == ["hi there", "src", "long enough", "src", "go go now"]


def test_strip_prompt_artifacts(spark):
    rows = ['assistant: "Hello"', "Текст: сүз", "{ text } x user:", "userx stays", None]
    got = one_col(spark, rows, T.strip_prompt_artifacts)
    assert got == ["Hello", "сүз", "x", "userx stays", ""]


def test_validity(spark):
    src = "x" * 100
    news = ["y" * 29, "y" * 30, "y" * 300, "y" * 301, "bad" + "y" * 50, "ab"]
    df = spark.createDataFrame([(i, n, src) for i, n in enumerate(news)] + [(9, "abc", "")],
                               "i int, n string, s string")
    got = [r["o"] for r in df.select("i", P.is_valid_rewrite("n", "s", ["bad"]).alias("o")).orderBy("i").collect()]
    assert got == [False, True, True, False, False, False, True]


def test_term_hits_counts_duplicates(spark):
    got = one_col(spark, ["Bad bad", "fine"], lambda c: P.term_hits(c, ["bad", "bad", "ad"]))
    assert got == [3, 0]


def test_word_overlap(spark):
    df = spark.createDataFrame([("a b c", "A x"), ("", "x")], "s string, n string")
    got = [r[0] for r in df.select(P.word_overlap("s", "n")).collect()]
    assert got == [1 / 3, 0.0]


def test_prompts(spark):
    df = spark.createDataFrame([("hi",)], "t string")
    r = df.select(T.build_prompt("t", "Q: {text}\nA:").alias("p"),
                  T.build_messages("t", "be kind", "{text}").alias("m")).first()
    assert r["p"] == "Q: hi\nA:"
    assert [(m["role"], m["content"]) for m in r["m"]] == [("system", "be kind"), ("user", "hi")]
    import pytest
    with pytest.raises(ValueError):
        T.build_prompt("t", "no slot")


def test_truncate_preview_single_line(spark):
    got = one_col(spark, ["a b  c d", "x"], lambda c: T.truncate_tokens(c, 2))
    assert got == ["a b", "x"]
    got = one_col(spark, ["abcdef"], lambda c: T.preview_text(c, 3))
    assert got == ["abc"]
    got = one_col(spark, ["a\r\nb\nc"], T.single_line)
    assert got == ["a b c"]


def test_cleanse_guard_is_exact(spark):
    rows = ["xabcx ab abc", "nothing here", "ABab", "a  b"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    a = df.select(T.cleanse("t", ["ab", "abc"], [r"x\s*y"], guard=True).alias("o")).collect()
    b = df.select(T.cleanse("t", ["ab", "abc"], [r"x\s*y"], guard=False).alias("o")).collect()
    assert a == b
    assert [r["o"] for r in a] == ["xcx c", "nothing here", "", "a b"]


def test_literal_with_regex_chars(spark):
    got = one_col(spark, ["a.b*c a?b", "$x\\y"], lambda c: T.remove_literals(c, ["a.b*c", "a?b", "$x\\"]))
    assert got == [" ", "y"]


def test_apply_rules_backreference(spark):
    got = one_col(spark, ["station nation"], lambda c: T.apply_rules(c, [(r"(\w+)tion\b", r"\1ce")]))
    assert got == ["stace nace"]
    got = one_col(spark, ["a b"], lambda c: T.apply_rules(c, [(r"a", "$1 \\")]))
    assert got == ["$1 \\ b"]


def test_split_lines_matches_python(spark):
    rows = ["a\nb\n", "a\r\nb", "a\x1cb\x1dc\x1ed", "a b", "", "\n", "a\n\nb"]
    got = one_col(spark, rows, T.split_lines)
    assert got == [r.splitlines() for r in rows]


def test_null_handling(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(T.cleanse("t", ["a"]).alias("a"), T.filter_tokens("t", ["a"]).alias("b"),
                  T.clean_generated("t", F.lit("s")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (None, None, "s")


def test_every_answer_prefix_in_both_cases(spark):
    rows, want = [], []
    for p in T.ANSWER_PREFIXES:
        for v in (p.lower(), p.upper()):
            rows.append(f"{v} ok text\nsecond")
            want.append("ok text")
    got = one_col(spark, rows, T.extract_first_line)
    assert got == want
