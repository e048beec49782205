"""Rule tables: ordering, compilation, cleansing and the lexicon linter."""

from one_column import one_col
from textguard.functions import lexicon as L


def test_rules_from_frame_orders_by_priority(spark):
    rules = [L.Rule(2, "regex", r"\bb\w*", "", "g"), L.Rule(1, "literal", "a.", "", "g"),
             L.Rule(3, "literal", "x", "Y", "g")]
    df = L.rules_to_frame(spark, rules)
    back = L.rules_from_frame(df)
    assert [r.priority for r in back] == [1, 2, 3]
    got = one_col(spark, ["a.b boo xa.x", "A.x"], lambda c: L.compile_rules(c, back))
    # 'a.' is a literal (the dot is not a wildcard), then \bb\w*, then x -> Y (case-insensitive)
    assert got == ["  YY", "Y"]


def test_cleanse_with_rule_table(spark):
    rules = L.literal_rules(["ab", "abc"]) + [L.Rule(10, "regex", r"x\s*y", "", "p")]
    got = one_col(spark, ["abcx y z", "nothing"], lambda c: L.cleanse_with(c, rules))
    assert got == ["c z", "nothing"]
    got = one_col(spark, ["abcx y z"], lambda c: L.remove_with(c, rules))
    assert got == ["c z"]


def test_lint_reports_duplicates_shadowed_and_mixed_script():
    terms = ["дурак", "дурак", "дураки", "xyz", "сoбака"]  # last one has a Latin 'o'
    issues = L.lint(terms)
    kinds = {(i["index"], i["issue"]) for i in issues}
    assert (1, "duplicate") in kinds
    assert (2, "shadowed") in kinds
    assert (4, "mixed_script") in kinds
    assert not any(i["index"] == 3 for i in issues)


def test_rule_report_shadowed_and_made(spark):
    from textguard.functions.lexicon import rule_report
    rules = [(r"\bbad\w*", ""), (r"badly", "x"), (r"ab", ""), (r"ac", ""), (r"never", "")]
    df = spark.createDataFrame([("badly done",), ("aabc",), (None,), ("an abc",)], "t string")
    got = [tuple(r) for r in rule_report(df, "t", rules).orderBy("rule").collect()]
    assert got == [(0, r"\bbad\w*", 1, 1, 0, 0), (1, "badly", 1, 0, 1, 0), (2, "ab", 2, 2, 0, 0), (3, "ac", 0, 1, 0, 1), (4, "never", 0, 0, 0, 0)]
