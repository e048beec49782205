"""Registered queries over the driver tables, each with its DuckDB oracle.

Every query reads whole tables (``documents``, ``labels``, ``conversations``,
``embeddings``, ``benchmark``) or frames Spark derives from them. Names are
``<operator id>_<name>``. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..session import broadcast_if_small, folder_bytes, read_table, table_path, with_size
from . import sqlgen as S

# --------------------------------------------------------------------------
# Fixed values for the driver tables: a test lexicon (words frequent only in
# toxic documents, plus one stem contained in two of them), a Latin stand-in
# for the obfuscation patterns, rule groups and replacements.
# --------------------------------------------------------------------------
TERMS = ["ononst", "hehely", "orantion", "inoran", "thatin", "oran"]
PATTERNS = [r"t\s*h\s*[e3*#]+", r"w\s*h\s*[o0]+"]
RULES = [
    (r"\bononst\b[^.]*\.", ""),          # threat-like phrase up to the next '.'
    (r"\bhehely\w*", ""),                # profanity stems
    (r"\binoran\b", ""),
    (r"\borantion\w*", ""),
    (r"\bthatin\b", ""),
    (r"\w*oran\w*", ""),                 # second-language stem
    (r"\bthe\b", "a"),                   # fluency replacements
    (r"(\w+)tion\b", r"\1ce"),
]
FALLBACK_RULES = RULES[1:3]
REPLACEMENTS = [("hehe", "haha"), ("orantion", ""), ("inor", "minor")]
PROMPT = "Rewrite politely: "
THRESHOLD = 0.5

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return _input(read_table(spark, sf, "documents"))


def _input(df: DataFrame) -> DataFrame:
    """The table as it is scanned; only a caller that knows its input has too
    few splits for its cores sets ``spark.textguard.inputPartitions``."""
    n = df.sparkSession.conf.get("spark.textguard.inputPartitions", None)
    return df.repartition(int(n)) if n else df


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """The labels, broadcast while their files are small: the texts they are
    joined to are then not shuffled."""
    return broadcast_if_small(with_size(read_table(spark, sf, "labels"), folder_bytes(spark, table_path(sf, "labels"))))


def r6(c):
    return F.round(c, 6)


def _model(kind: str, spark, sf, build):
    """Train or store for this query; the tables are written to the
    checkpoint folder, so the query's branches only read them."""
    return build()


# ==========================================================================
# 1. cleaning projections on documents
# ==========================================================================

@register("c1_remove_literals",
          f"SELECT doc_id, {S.nested_replace('text', TERMS)} AS out FROM documents")
def c1_remove_literals(spark, sf):
    return docs(spark, sf).select("doc_id", T.remove_literals("text", TERMS).alias("out"))


@register("c2_remove_patterns",
          f"SELECT doc_id, {S.nested_replace('text', PATTERNS)} AS out FROM documents")
def c2_remove_patterns(spark, sf):
    return docs(spark, sf).select("doc_id", T.remove_patterns("text", PATTERNS).alias("out"))


@register("c3_collapse_ws", f"SELECT doc_id, {S.collapse('text')} AS out FROM documents")
def c3_collapse_ws(spark, sf):
    return docs(spark, sf).select("doc_id", T.collapse_ws("text").alias("out"))


_C4_SQL = S.collapse(S.nested_replace(S.nested_replace("text", TERMS), PATTERNS))


@register("c4_cleanse", f"SELECT doc_id, {_C4_SQL} AS cleaned FROM documents")
def c4_cleanse(spark, sf):
    return docs(spark, sf).select("doc_id", T.cleanse("text", TERMS, PATTERNS).alias("cleaned"))


@register("c7_normalize_punct", f"SELECT doc_id, {S.normalize_punct('text')} AS out FROM documents")
def c7_normalize_punct(spark, sf):
    return docs(spark, sf).select("doc_id", T.normalize_punct("text").alias("out"))


@register("c10_drop_tokens",
          f"SELECT doc_id, array_to_string(list_filter({S.split_ws('text')}, "
          f"lambda x: NOT regexp_matches(x, '[0-9]')), ' ') AS out FROM documents")
def c10_drop_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", T.drop_tokens_matching("text", "[0-9]").alias("out"))


_C15_SQL = S.collapse("regexp_replace(text, '[\\r\\n]', ' ', 'g')")


@register("c15_single_line", f"SELECT doc_id, {_C15_SQL} AS out FROM documents")
def c15_single_line(spark, sf):
    return docs(spark, sf).select("doc_id", T.single_line("text").alias("out"))


@register("c17_truncate_tokens",
          f"SELECT doc_id, array_to_string(({S.split_ws('text')})[1:20], ' ') AS out FROM documents")
def c17_truncate_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", T.truncate_tokens("text", 20).alias("out"))


@register("c20_preview_text", "SELECT doc_id, substr(text, 1, 80) AS out FROM documents")
def c20_preview_text(spark, sf):
    return docs(spark, sf).select("doc_id", T.preview_text("text", 80).alias("out"))


# ==========================================================================
# 2. predicates, gate, merge, reports
# ==========================================================================

_LATIN_DROPPED = (f"array_to_string(list_filter({S.split_ws('text')}, "
                  f"lambda x: NOT regexp_matches(x, '[A-Za-z]')), ' ')")


@register("p2_is_blank",
          rf"SELECT doc_id, lang, ({_LATIN_DROPPED} IS NULL OR regexp_matches({_LATIN_DROPPED}, '^\s*$')) "
          "AS blank FROM documents")
def p2_is_blank(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", "lang", P.is_blank(T.drop_tokens_matching("text")).alias("blank"))


@register("p6_term_hits", f"SELECT doc_id, {S.term_hits('text', TERMS)} AS hits FROM documents")
def p6_term_hits(spark, sf):
    return docs(spark, sf).select("doc_id", P.term_hits("text", TERMS).alias("hits"))


def _valid_sql(new: str, src: str) -> str:
    ratio = f"(CASE WHEN length({src}) > 0 THEN length({new}) / length({src}) ELSE 1.0 END)"
    return (f"({new} IS NOT NULL AND length(trim({new})) >= 3 AND {ratio} >= 0.3 AND {ratio} <= 3.0 "
            f"AND {S.term_hits(new, TERMS)} = 0)")


@register("p5_is_valid_rewrite",
          f"SELECT doc_id, {_valid_sql('c', 'text')} AS valid FROM "
          f"(SELECT doc_id, text, {S.collapse(S.nested_replace('text', TERMS))} AS c FROM documents)")
def p5_is_valid_rewrite(spark, sf):
    d = docs(spark, sf).withColumn("c", T.cleanse("text", TERMS))
    return d.select("doc_id", P.is_valid_rewrite("c", "text", TERMS).alias("valid"))


#: A lexicon of thousands of terms: words that stand in documents labelled toxic and in no other labelled one.
LEXICON = 5000
_LEX_SQL = f"""w AS (SELECT DISTINCT toxic, unnest(regexp_extract_all(lower(text), '[a-z]{{5,}}')) AS w FROM documents JOIN labels USING (doc_id)),
 lex AS (SELECT w FROM w GROUP BY w HAVING min(toxic) = 1 ORDER BY md5(w) LIMIT {LEXICON}),
 terms AS (SELECT list(w ORDER BY md5(w)) AS ts FROM lex)"""


def lexicon(spark, sf) -> list[str]:
    """The terms in their order: a user's list, which the driver holds."""
    words = labelled_docs(spark, sf).select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))).alias("w"))
    found = words.groupBy("w").agg(F.min("toxic").alias("least")).where("least = 1").orderBy(F.md5("w")).limit(LEXICON)
    return [r.w for r in found.select("w").collect()]


@register("p6_large_lexicon",
          f"WITH {_LEX_SQL} SELECT doc_id, CAST(len(list_filter(ts, lambda t: contains(low, t))) AS INTEGER) AS hits "
          "FROM (SELECT doc_id, lower(text) AS low FROM documents), terms")
def p6_large_lexicon(spark, sf):
    """P6 with thousands of terms: a search per layer of the lexicon."""
    return docs(spark, sf).select("doc_id", P.term_hits("text", lexicon(spark, sf)).alias("hits"))


@register("c1_large_lexicon",
          f"WITH {_LEX_SQL} SELECT doc_id, list_reduce(list_prepend(text, ts), lambda acc, t: "
          "CASE WHEN contains(lower(acc), t) THEN regexp_replace(acc, t, '', 'gi') ELSE acc END) AS out FROM documents, terms")
def c1_large_lexicon(spark, sf):
    """C1 with thousands of terms; the SQL deletes one after the other."""
    return docs(spark, sf).select("doc_id", T.remove_literals("text", lexicon(spark, sf)).alias("out"))


_SET = "list_distinct({})"


@register("j6_word_overlap",
          "SELECT doc_id, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS overlap FROM "
          f"(SELECT doc_id, list_distinct({S.split_ws('lower(text)')}) AS a, "
          f"list_distinct({S.split_ws('lower(' + _C4_SQL + ')')}) AS b FROM documents)")
def j6_word_overlap(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", r6(P.word_overlap("text", T.cleanse("text", TERMS, PATTERNS))).alias("overlap"))


def _g1_sql() -> str:
    edit = S.drop_toxic("text", TERMS)
    out = f"CASE WHEN {S.term_hits('text', TERMS)} >= 1 THEN {edit} ELSE {_C4_SQL} END"
    return (rf"SELECT doc_id, lang, text, CASE WHEN o IS NULL OR regexp_matches(o, '^\s*$') THEN text ELSE o END "
            f"AS rewrite, edited FROM (SELECT doc_id, lang, text, {out} AS o, "
            f"{S.term_hits('text', TERMS)} >= 1 AS edited FROM documents)")


def gated_rewrites(spark, sf) -> DataFrame:
    """Flagship flow on ``documents``: C4 -> P6 score on the raw text -> P1
    gate -> G1 (C9b editor on gated rows) -> G2 fallback to the source."""
    from ..operators.gate import gated_edit
    d = docs(spark, sf).withColumn("cleaned", T.cleanse("text", TERMS, PATTERNS)) \
        .withColumn("score", P.term_hits("text", TERMS).cast("double"))
    g = gated_edit(d, P.gate("score", 1.0), "text", "edit",
                   editor=lambda c: T.drop_toxic_tokens(c, TERMS))
    out = F.when(P.gate("score", 1.0), F.col("edit")).otherwise(F.col("cleaned"))
    return g.select("doc_id", "lang", "text", P.fallback(out, F.col("text")).alias("rewrite"),
                    P.gate("score", 1.0).alias("edited"))


def stored_rewrites(spark, sf) -> DataFrame:
    """The flagship flow's output written once (shared checkpoint folder)
    for the evaluation queries, which read it as a table: several metric
    branches then scan it instead of recomputing the cleaning chain each."""
    from ..session import materialize
    return _model("rewrites", spark, sf, lambda: materialize(gated_rewrites(spark, sf), "rewrites"))


@register("g1_gated_edit", f"SELECT doc_id, rewrite, edited FROM ({_g1_sql()})")
def g1_gated_edit(spark, sf):
    return gated_rewrites(spark, sf).select("doc_id", "rewrite", "edited")


@register("a11_table_report",
          rf"""SELECT lang, count(*) AS n_rows,
 CAST(sum(CASE WHEN rewrite IS NULL OR regexp_matches(rewrite, '^\s*$') THEN 1 ELSE 0 END) AS BIGINT) AS n_blank_rewrite,
 CAST(sum(CASE WHEN text IS NULL OR regexp_matches(text, '^\s*$') THEN 1 ELSE 0 END) AS BIGINT) AS n_blank_source,
 round(avg(length(text)), 6) AS avg_len_source, round(avg(length(rewrite)), 6) AS avg_len_rewrite
 FROM ({_g1_sql()}) GROUP BY lang""")
def a11_table_report(spark, sf):
    from ..operators.metrics import table_report
    r = table_report(gated_rewrites(spark, sf), "text", "rewrite", ["lang"])
    return r.select("lang", "n_rows", "n_blank_rewrite", "n_blank_source",
                    r6(F.col("avg_len_source")).alias("avg_len_source"),
                    r6(F.col("avg_len_rewrite")).alias("avg_len_rewrite"))


# ==========================================================================
# 3. rule groups, replacements, ladder, token filters
# ==========================================================================

#: The rules in RE2, whose \\b and \\w know ASCII alone: word edges are captured
#: and put back, in a second pass where matches share an edge.
_W, _N = r"[\pL\pN_]", r"[^\pL\pN_]"
_RULES_SQL = dict(zip([p for p, _ in RULES], [
    (rf"(^|{_N})ononst(?:[^\pL\pN_.][^.]*)?\.", r"\1", 2),
    (rf"(^|{_N})hehely{_W}*", r"\1", 1),
    (rf"(^|{_N})inoran($|{_N})", r"\1\2", 2),
    (rf"(^|{_N})orantion{_W}*", r"\1", 1),
    (rf"(^|{_N})thatin($|{_N})", r"\1\2", 2),
    (rf"{_W}*oran{_W}*", "", 1),
    (rf"(^|{_N})the($|{_N})", r"\1a\2", 2),
    (rf"({_W}+)tion($|{_N})", r"\1ce\2", 2)], strict=True))


def _rules_sql(expr: str, rules) -> str:
    return S.rules(expr, [x for p, _ in rules for x in [_RULES_SQL[p][:2]] * _RULES_SQL[p][2]])


_EN = "FROM documents"


@register("c5_rule_groups", f"SELECT doc_id, {_rules_sql('text', RULES[:6])} AS out {_EN}")
def c5_rule_groups(spark, sf):
    return docs(spark, sf).select("doc_id", T.apply_rules("text", RULES[:6]).alias("out"))


@register("c6_replace_rules", f"SELECT doc_id, {_rules_sql('text', RULES[6:])} AS out {_EN}")
def c6_replace_rules(spark, sf):
    return docs(spark, sf).select("doc_id", T.apply_rules("text", RULES[6:]).alias("out"))


def _c8_sql() -> str:
    r_full = S.normalize_punct(_rules_sql("text", RULES))
    r_light = S.normalize_punct(_rules_sql("text", FALLBACK_RULES))
    return (rf"""trim(CASE WHEN r_full = '' OR length(trim(r_full)) < 2 THEN
   (CASE WHEN r_light IS NULL OR regexp_matches(r_light, '^\s*$') THEN text ELSE r_light END)
   ELSE r_full END) AS out FROM (SELECT doc_id, text, {r_full} AS r_full, {r_light} AS r_light {_EN})""")


@register("c8_rule_clean", f"SELECT doc_id, {_c8_sql()}")
def c8_rule_clean(spark, sf):
    return docs(spark, sf).select("doc_id", T.rule_clean("text", RULES, FALLBACK_RULES).alias("out"))


def _rule_report_sql() -> str:
    """The text before each rule, then the rule against it and against the source."""
    steps, expr = [], "text"
    for i, (p, _) in enumerate(RULES):
        pattern = _RULES_SQL[p][0]
        steps.append(f"SELECT {i} AS rule, {S.q(p)} AS pattern, regexp_matches(text, {S.q(pattern)}, 'i') AS a, regexp_matches({expr}, {S.q(pattern)}, 'i') AS c FROM documents")
        expr = _rules_sql(expr, [RULES[i]])
    n = lambda x: f"CAST(count(*) FILTER ({x}) AS BIGINT)"
    return (f"SELECT rule, pattern, {n('a')} AS n_alone, {n('c')} AS n_chain, {n('a AND NOT c')} AS n_shadowed, {n('c AND NOT a')} AS n_made "
            f"FROM ({' UNION ALL '.join(steps)}) GROUP BY rule, pattern")


@register("c8_rule_report", _rule_report_sql())
def c8_rule_report(spark, sf):
    """Which rules of the ladder fire alone, and which in the chain."""
    from ..functions.lexicon import rule_report
    return rule_report(docs(spark, sf), "text", RULES)


@register("c9_filter_tokens", f"SELECT doc_id, {S.filter_tokens('text', TERMS, REPLACEMENTS)} AS out {_EN}")
def c9_filter_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", T.filter_tokens("text", TERMS, REPLACEMENTS).alias("out"))


@register("c9b_drop_toxic_tokens", f"SELECT doc_id, {S.drop_toxic('text', TERMS)} AS out {_EN}")
def c9b_drop_toxic_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", T.drop_toxic_tokens("text", TERMS).alias("out"))


# ==========================================================================
# 4. output repair on conversations (artifacts added by literal concat)
# ==========================================================================

def convs(spark, sf):
    return _input(read_table(spark, sf, "conversations"))


_C11_IN_SQL = ("CASE role WHEN 'user' THEN concat('user: ', text) "
               "WHEN 'assistant' THEN concat('assistant: \"', text, '\" {text}') "
               "ELSE concat('Текст: ', text) END")


def _c11_in():
    return (F.when(F.col("role") == "user", F.concat(F.lit("user: "), "text"))
            .when(F.col("role") == "assistant", F.concat(F.lit('assistant: "'), "text", F.lit('" {text}')))
            .otherwise(F.concat(F.lit("Текст: "), "text")))


def _c11_sql(x: str) -> str:
    for w in ("Текст", "Детокс", "Токсик"):
        x = f"regexp_replace({x}, {S.q(S.label_pattern(w))}, '\\1\\3', 'g')"
    x = rf"regexp_replace({x}, '\{{\s*text\s*\}}', '', 'gi')"
    for w in ("user", "assistant"):
        x = f"regexp_replace({x}, {S.q(S.label_pattern(w))}, '\\1\\3', 'g')"
    c = S.collapse(x)
    return (f"(SELECT {S.strip(S.q('') + ' || ' + 'regexp_replace(u, ' + S.q('(?i)^(Текст|Детокс|Токсик)\\s*:\\s*') + ', ' + S.q('') + ')')} "
            f"FROM (SELECT CASE WHEN (starts_with(c, '\"') AND ends_with(c, '\"')) OR "
            f"(starts_with(c, '''') AND ends_with(c, '''')) THEN {S.strip('substr(c, 2, length(c) - 2)')} "
            f"ELSE c END AS u FROM (SELECT {c} AS c)))")


@register("c11_strip_prompt_artifacts",
          f"SELECT conv_id, turn, {_c11_sql(_C11_IN_SQL)} AS out FROM conversations")
def c11_strip_prompt_artifacts(spark, sf):
    return convs(spark, sf).select("conv_id", "turn", T.strip_prompt_artifacts(_c11_in()).alias("out"))


def _c12_in():
    first5 = T.truncate_tokens("text", 5)
    return F.when(F.col("role") == "assistant",
                  F.concat("text", F.lit("\nDetoxed: "), first5, F.lit('"\n(Translation: none)'))
                  ).otherwise(F.col("text"))


_C12_IN_SQL = (f"CASE WHEN role = 'assistant' THEN concat(text, chr(10) || 'Detoxed: ', "
               f"array_to_string(({S.split_ws('text')})[1:5], ' '), '\"' || chr(10) || '(Translation: none)') "
               f"ELSE text END")


def _c12_sql(x: str) -> str:
    t = S.strip(x)
    lines = (f"list_filter(list_transform(string_split(CASE WHEN starts_with(t, '\"') AND ends_with(t, '\"') "
             f"THEN substr(t, 2, length(t) - 2) ELSE t END, chr(10)), lambda l: {S.strip('l')}), "
             f"lambda l: l <> '')")
    last = "len(ls) - list_position(list_reverse(list_transform(ls, lambda l: starts_with(l, 'Detoxed:'))), true) + 1"
    after = ("list_filter(ls[lm + 1:], lambda l: NOT (starts_with(l, '(') AND contains(l, 'Translation')))")
    cand = (f"CASE WHEN len(ls) = 0 THEN '' WHEN lm IS NULL THEN ls[-1] "
            f"ELSE coalesce({after}[1], ls[lm]) END")
    s1 = (f"CASE WHEN starts_with(c0, 'Detoxed:assistant') THEN {S.strip('substr(c0, 18)')} ELSE c0 END")
    s2 = (f"CASE WHEN starts_with(c1, 'Detoxed:') THEN {S.strip('substr(c1, 9)')} ELSE c1 END")
    s3 = ("CASE WHEN ends_with(c2, '\"') THEN regexp_replace(substr(c2, 1, length(c2) - 1), '\\s+$', '') "
          "ELSE c2 END")
    return (f"(SELECT {s3} FROM (SELECT {s2} AS c2 FROM (SELECT {s1} AS c1 FROM (SELECT {cand} AS c0 FROM "
            f"(SELECT ls, {last} AS lm FROM (SELECT {lines} AS ls FROM (SELECT {t} AS t)))))))")


@register("c12_extract_marked_answer",
          f"SELECT conv_id, turn, {_c12_sql(_C12_IN_SQL)} AS out FROM conversations")
def c12_extract_marked_answer(spark, sf):
    return convs(spark, sf).select("conv_id", "turn", T.extract_marked_answer(_c12_in()).alias("out"))


def _c13_in():
    return F.when(F.col("role") == "assistant", F.concat(F.lit('Assistant: "'), "text", F.lit('"'))) \
        .otherwise(F.concat(F.lit("answer"), "text"))


_C13_IN_SQL = ("CASE WHEN role = 'assistant' THEN concat('Assistant: \"', text, '\"') "
               "ELSE concat('answer', text) END")


def _c13_sql(x: str) -> str:
    first = S.strip(f"coalesce(string_split({S.strip(x)}, chr(10))[1], '')")
    branches = []
    for p in T.ANSWER_PREFIXES:
        rest = S.strip(f"regexp_replace(substr(f, {len(p) + 1}), '^:+', '')")
        branches.append(f"WHEN starts_with(lower(f), {S.q(p.lower())}) THEN {rest}")
    cut = "CASE " + " ".join(branches) + " ELSE f END"
    unq = (f"CASE WHEN starts_with(g, '\"') AND ends_with(g, '\"') AND length(g) > 1 "
           f"THEN {S.strip('substr(g, 2, length(g) - 2)')} ELSE g END")
    return f"(SELECT {unq} FROM (SELECT {cut} AS g FROM (SELECT {first} AS f)))"


@register("c13_extract_first_line",
          f"SELECT conv_id, turn, {_c13_sql(_C13_IN_SQL)} AS out FROM conversations")
def c13_extract_first_line(spark, sf):
    return convs(spark, sf).select("conv_id", "turn", T.extract_first_line(_c13_in()).alias("out"))


def _c14_in():
    return F.when(F.col("role") == "assistant", F.concat(F.lit(PROMPT), "text", F.lit("\n"), "text")) \
        .otherwise(F.concat(F.lit('"'), "text", F.lit('"')))


_C14_IN_SQL = (f"CASE WHEN role = 'assistant' THEN concat({S.q(PROMPT)}, text, chr(10), text) "
               f"ELSE concat('\"', text, '\"') END")


def _c14_sql(x: str, src: str) -> str:
    t = f"CASE WHEN contains(g, {S.q(PROMPT)}) THEN {S.strip('replace(g, ' + S.q(PROMPT) + ', ' + S.q('') + ')')} ELSE g END"
    lines = f"list_filter(list_transform(string_split(t, chr(10)), lambda l: {S.strip('l')}), lambda l: l <> '')"
    # distinct lines keeping first occurrence order
    dl = "list_filter(ls, lambda l, i: list_position(ls, l) = i)"
    uq = f"list_transform(dl, lambda l: {S.strip(chr(39).join(['trim(trim(l, ', '\"', '), ', chr(39) * 2, ')']))})"
    choose = "coalesce(list_filter(uq, lambda l: length(l) >= 3)[1], uq[1])"
    res = f"CASE WHEN r IS NULL OR length(r) < 3 THEN s ELSE r END"
    words = S.split_ws(S.collapse("r2"))
    return (f"(SELECT CASE WHEN g IS NULL OR g = '' THEN s ELSE {S.keep_two_repeats(words)} END FROM "
            f"(SELECT {res} AS r2 FROM (SELECT {choose} AS r FROM (SELECT {uq} AS uq FROM "
            f"(SELECT {dl} AS dl FROM (SELECT {lines} AS ls FROM (SELECT {t} AS t)))))))")


@register("c14_clean_generated",
          f"SELECT conv_id, turn, {_c14_sql('g', 's')} AS out FROM "
          f"(SELECT conv_id, turn, {_C14_IN_SQL} AS g, text AS s FROM conversations)")
def c14_clean_generated(spark, sf):
    return convs(spark, sf).select("conv_id", "turn",
                                   T.clean_generated(_c14_in(), F.col("text"), PROMPT).alias("out"))


@register("c16_build_prompt",
          f"SELECT conv_id, turn, concat({S.q(PROMPT)}, text, chr(10) || 'Answer:') AS prompt FROM conversations")
def c16_build_prompt(spark, sf):
    return convs(spark, sf).select("conv_id", "turn",
                                   T.build_prompt("text", PROMPT + "{text}\nAnswer:").alias("prompt"))


@register("c16_chat_messages",
          f"""SELECT conv_id, turn, 0 AS pos, 'system' AS role, {S.q(PROMPT)} AS content FROM conversations
 UNION ALL SELECT conv_id, turn, 1, 'user', concat('Text: ', text) FROM conversations""")
def c16_chat_messages(spark, sf):
    """The chat messages of every turn, one row per message."""
    m = T.build_messages("text", PROMPT, "Text: {text}")
    return convs(spark, sf).select("conv_id", "turn", F.posexplode(m).alias("pos", "m")).select(
        "conv_id", "turn", "pos", "m.role", "m.content")


@register("p8_malformed_rows",
          """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang,
 doc_id % 11 = 0 OR doc_id % 7 = 0 AS malformed FROM documents""")
def p8_malformed_rows(spark, sf):
    """Raw TSV lines, some a field short, some a field long, read back
    whole, each malformed line marked."""
    from ..sources import io as IO
    path = _scratch(spark, "malformed")
    line = F.when(F.col("doc_id") % 11 == 0, F.col("doc_id").cast("string")) \
        .when(F.col("doc_id") % 7 == 0, F.concat_ws("\t", "doc_id", "lang", F.lit("extra"))).otherwise(F.concat_ws("\t", "doc_id", "lang"))
    docs(spark, sf).select(line.alias("value")).write.text(path)
    back = IO.read_tsv(spark, path, schema="doc_id long, lang string, bad string", malformed_col="bad", header=False)
    return back.select("doc_id", "lang", F.col("bad").isNotNull().alias("malformed"))


@register("a10_mean_quality",
          """SELECT lang, round(avg(CASE WHEN quality = 1 THEN n_chars / 1000.0 END), 6) AS mean_quality, count(*) AS n_rows
 FROM documents JOIN labels USING (doc_id) GROUP BY lang""")
def a10_mean_quality(spark, sf):
    """A10: mean of a supplied score whose missing values are NaN."""
    from ..operators.metrics import nanmean
    score = F.when(F.col("quality") == 1, F.col("n_chars") / 1000.0).otherwise(F.lit(float("nan")))
    rows = read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(read_table(spark, sf, "labels"), "doc_id")
    return rows.withColumn("score", score).groupBy("lang").agg(r6(nanmean("score")).alias("mean_quality"), F.count("*").alias("n_rows"))


# ==========================================================================
# 5./6. trained scorers and metrics (documents + labels)
# ==========================================================================

def nb_model(spark, sf):
    from ..operators.scoring import train_naive_bayes
    lab = docs(spark, sf).join(labels(spark, sf), "doc_id")
    return _model("nb", spark, sf, lambda: train_naive_bayes(lab, "text", "toxic"))


def nb_scored(spark, sf, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    from ..operators.scoring import score_naive_bayes
    w, pr = nb_model(spark, sf)
    return score_naive_bayes(df, w, pr, "doc_id", text_col, out_col)


_TOK = "regexp_extract_all(lower({}), '[a-z]+')"

_NB_SQL = f"""
 lab AS (SELECT d.text, l.toxic FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL),
 ltok AS (SELECT toxic, unnest({_TOK.format('text')}) AS w FROM lab),
 cnt AS (SELECT w, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS c1,
                sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS c0 FROM ltok GROUP BY w),
 tot AS (SELECT sum(c1) AS n1, sum(c0) AS n0, count(*) AS v FROM cnt),
 pri AS (SELECT ln(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::DOUBLE
                   / sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END)) AS prior FROM lab),
 wt AS (SELECT w, ln((c1 + 1) / (n1 + v)) - ln((c0 + 1) / (n0 + v)) AS weight FROM cnt, tot)"""


def _nb_score_sql(src_cte: str, text_col: str, tag: str = "", with_model: bool = True) -> str:
    """``src_cte`` has (doc_id, <text_col>); returns CTEs ending in
    scored<tag>(doc_id, p). The model CTEs are emitted once (with_model)."""
    model = f"{_NB_SQL}," if with_model else ""
    return f"""{model}
 dt{tag} AS (SELECT doc_id, unnest({_TOK.format(text_col)}) AS w FROM {src_cte}),
 sc{tag} AS (SELECT doc_id, sum(weight) AS s FROM dt{tag} JOIN wt USING (w) GROUP BY doc_id),
 scored{tag} AS (SELECT x.doc_id, 1.0 / (1.0 + exp(-greatest(-30.0, least(30.0, prior + coalesce(s, 0.0))))) AS p
            FROM {src_cte} x LEFT JOIN sc{tag} USING (doc_id), pri)"""


@register("m1_nb_score", f"WITH {_nb_score_sql('documents', 'text')} SELECT doc_id, round(p, 6) AS p_toxic FROM scored")
def m1_nb_score(spark, sf):
    return nb_scored(spark, sf, docs(spark, sf), "text", "p").select("doc_id", r6(F.col("p")).alias("p_toxic"))


@register("a4_accuracy",
          f"""WITH {_nb_score_sql('documents', 'text')}
 SELECT CAST(sum(CASE WHEN p >= 0.5 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
        CAST(sum(CASE WHEN p >= 0.5 AND toxic <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN p < 0.5 AND toxic <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
        CAST(sum(CASE WHEN p < 0.5 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
        round(avg(CASE WHEN (p >= 0.5)::INT = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy
 FROM scored JOIN labels USING (doc_id)""")
def a4_accuracy(spark, sf):
    from ..operators.metrics import confusion
    s = nb_scored(spark, sf, docs(spark, sf), "text", "p").join(read_table(spark, sf, "labels"), "doc_id")
    c = confusion(s, "p", "toxic", THRESHOLD)
    return c.select("tp", "fp", "tn", "fn", r6(F.col("accuracy")).alias("accuracy"))


_RW_CTE = f"rw AS ({_g1_sql()})"


def _scored_rewrites(spark, sf):
    """Score source and rewrite in one pass (one token join, one join back)."""
    from ..operators.scoring import score_naive_bayes_many
    w, prior = nb_model(spark, sf)
    return score_naive_bayes_many(stored_rewrites(spark, sf), w, prior, "doc_id",
                                  {"p_before": "text", "p_after": "rewrite"})


_BA_SQL = f"""WITH {_RW_CTE}, {_NB_SQL},
 b AS (SELECT doc_id, unnest({_TOK.format('text')}) AS w FROM rw),
 a AS (SELECT doc_id, unnest({_TOK.format('rewrite')}) AS w FROM rw),
 sb AS (SELECT doc_id, sum(weight) AS s FROM b JOIN wt USING (w) GROUP BY doc_id),
 sa AS (SELECT doc_id, sum(weight) AS s FROM a JOIN wt USING (w) GROUP BY doc_id),
 ev AS (SELECT rw.doc_id, rw.lang, rw.edited, rw.text, rw.rewrite,
   1.0 / (1.0 + exp(-greatest(-30.0, least(30.0, prior + coalesce(sb.s, 0.0))))) AS p_before,
   1.0 / (1.0 + exp(-greatest(-30.0, least(30.0, prior + coalesce(sa.s, 0.0))))) AS p_after
   FROM rw LEFT JOIN sb USING (doc_id) LEFT JOIN sa USING (doc_id), pri)"""


@register("a12_before_after",
          f"""{_BA_SQL} SELECT edited, count(*) AS n_rows, round(avg(p_before), 6) AS avg_p_before,
 round(avg(p_after), 6) AS avg_p_after FROM ev GROUP BY edited""")
def a12_before_after(spark, sf):
    from ..operators.metrics import before_after_report
    r = before_after_report(_scored_rewrites(spark, sf), "p_before", "p_after", "edited")
    return r.select("edited", "n_rows", r6(F.col("avg_p_before")).alias("avg_p_before"),
                    r6(F.col("avg_p_after")).alias("avg_p_after"))


@register("a1_sta",
          f"""{_BA_SQL} SELECT lang, round(avg(CASE WHEN p_after < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS sta,
 count(*) AS n_rows FROM ev GROUP BY lang""")
def a1_sta(spark, sf):
    from ..operators.metrics import sta
    return _scored_rewrites(spark, sf).groupBy("lang").agg(r6(sta("p_after", THRESHOLD)).alias("sta"),
                                                            F.count("*").alias("n_rows"))


def _bag_sql(cte: str, col: str, name: str) -> str:
    return (f"{name} AS (SELECT doc_id, w, count(*) AS n FROM "
            f"(SELECT doc_id, unnest({_TOK.format(col)}) AS w FROM {cte}) GROUP BY doc_id, w)")


_SIM_SQL = f"""WITH {_RW_CTE}, {_bag_sql('rw', 'text', 'ba')}, {_bag_sql('rw', 'rewrite', 'bb')},
 dotp AS (SELECT doc_id, sum(ba.n * bb.n) AS d FROM ba JOIN bb USING (doc_id, w) GROUP BY doc_id),
 na AS (SELECT doc_id, sqrt(sum(n * n)) AS x FROM ba GROUP BY doc_id),
 nb AS (SELECT doc_id, sqrt(sum(n * n)) AS x FROM bb GROUP BY doc_id),
 sims AS (SELECT rw.doc_id, rw.lang, CASE WHEN na.x IS NULL OR nb.x IS NULL THEN 0.0
            ELSE coalesce(dotp.d, 0) / (na.x * nb.x) END AS sim
          FROM rw LEFT JOIN dotp USING (doc_id) LEFT JOIN na USING (doc_id) LEFT JOIN nb USING (doc_id))"""


def _sims(spark, sf):
    from ..operators.scoring import text_similarity
    g = stored_rewrites(spark, sf)
    return g.select("doc_id", "lang", text_similarity("text", "rewrite").alias("sim"))


@register("m6_text_similarity", f"{_SIM_SQL} SELECT doc_id, round(sim, 6) AS sim FROM sims")
def m6_text_similarity(spark, sf):
    return _sims(spark, sf).select("doc_id", r6(F.col("sim")).alias("sim"))


@register("a2_mean_similarity", f"{_SIM_SQL} SELECT lang, round(avg(sim), 6) AS sim FROM sims GROUP BY lang")
def a2_mean_similarity(spark, sf):
    from ..operators.metrics import sim
    return _sims(spark, sf).groupBy("lang").agg(r6(sim("sim")).alias("sim"))


def bigram_model(spark, sf):
    from ..operators.scoring import train_bigrams
    return _model("bigram", spark, sf, lambda: train_bigrams(docs(spark, sf), "text"))


_BG_MODEL_SQL = f"""
 rt AS (SELECT {_TOK.format('text')} AS t FROM documents),
 rp AS (SELECT t[i] AS a, t[i + 1] AS b FROM (SELECT t, unnest(range(1, len(t))) AS i FROM rt)),
 pairs AS (SELECT a, b, count(*) AS cab FROM rp GROUP BY a, b),
 starts AS (SELECT a, sum(cab) AS ca FROM pairs GROUP BY a),
 vocab AS (SELECT count(DISTINCT w) AS v FROM (SELECT unnest(t) AS w FROM rt))"""


def _nll_sql(cte: str, col: str) -> str:
    return f"""{_BG_MODEL_SQL},
 xt AS (SELECT doc_id, {_TOK.format(col)} AS t FROM {cte}),
 xp AS (SELECT doc_id, t[i] AS a, t[i + 1] AS b FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM xt)),
 xs AS (SELECT doc_id, sum(-ln((coalesce(cab, 0) + 1.0) / (coalesce(ca, 0) + v))) AS nll_sum, count(*) AS n_pred
        FROM xp LEFT JOIN pairs USING (a, b) LEFT JOIN starts USING (a), vocab GROUP BY doc_id),
 nll AS (SELECT xt.doc_id, coalesce(nll_sum, 0.0) AS nll_sum, coalesce(n_pred, 0) AS n_pred, len(t) AS n_tokens
         FROM xt LEFT JOIN xs USING (doc_id))"""


def _nll(spark, sf, df: DataFrame, col: str) -> DataFrame:
    from ..operators.scoring import bigram_nll
    return bigram_nll(df, bigram_model(spark, sf), "doc_id", col)


@register("m7_text_perplexity",
          f"WITH {_RW_CTE}, {_nll_sql('rw', 'rewrite')} SELECT doc_id, "
          "round(CASE WHEN n_tokens >= 3 THEN exp(nll_sum / n_pred) END, 6) AS ppl FROM nll")
def m7_text_perplexity(spark, sf):
    from ..operators.scoring import text_perplexity
    p = text_perplexity(_nll(spark, sf, stored_rewrites(spark, sf), "rewrite"), "doc_id")
    return p.select("doc_id", r6(F.col("ppl")).alias("ppl"))


@register("a6_corpus_perplexity",
          f"WITH {_nll_sql('documents', 'text')} SELECT round(CASE WHEN sum(n_pred) > 0 THEN "
          "exp(sum(nll_sum) / sum(n_pred)) ELSE 'inf'::DOUBLE END, 6) AS corpus_ppl, CAST(sum(n_pred) AS BIGINT) AS n_pred "
          "FROM nll")
def a6_corpus_perplexity(spark, sf):
    from ..operators.scoring import corpus_perplexity
    c = corpus_perplexity(_nll(spark, sf, docs(spark, sf), "text"))
    return c.select(r6(F.col("corpus_ppl")).alias("corpus_ppl"), "n_pred")


_BUCKET = "(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) % 16384)"


def _hbag_sql(cte: str, col: str, name: str) -> str:
    return (f"{name} AS (SELECT doc_id, b, count(*) * max(idf) AS n FROM (SELECT doc_id, {_BUCKET.format('w')} AS b FROM "
            f"(SELECT doc_id, unnest({_TOK.format(col)}) AS w FROM {cte})) JOIN idf USING (b) GROUP BY doc_id, b HAVING count(*) * max(idf) <> 0)")


@register("m6_tfidf_similarity",
          f"""WITH {_RW_CTE}, n AS (SELECT count(*) AS n FROM documents),
 df AS (SELECT b, count(*) AS df FROM (SELECT DISTINCT doc_id, {_BUCKET.format('w')} AS b FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS w FROM documents)) GROUP BY b),
 idf AS (SELECT r.b, ln((n + 1) / (coalesce(df, 0) + 1)) AS idf FROM range(16384) r(b) LEFT JOIN df USING (b), n),
 {_hbag_sql('rw', 'text', 'ba')}, {_hbag_sql('rw', 'rewrite', 'bb')},
 dotp AS (SELECT doc_id, sum(ba.n * bb.n) AS d FROM ba JOIN bb USING (doc_id, b) GROUP BY doc_id),
 na AS (SELECT doc_id, sqrt(sum(n * n)) AS x FROM ba GROUP BY doc_id), nb AS (SELECT doc_id, sqrt(sum(n * n)) AS x FROM bb GROUP BY doc_id)
 SELECT rw.doc_id, round(CASE WHEN na.x IS NULL OR nb.x IS NULL THEN 0.0 ELSE coalesce(d, 0) / (na.x * nb.x) END, 6) AS sim
 FROM rw LEFT JOIN dotp USING (doc_id) LEFT JOIN na USING (doc_id) LEFT JOIN nb USING (doc_id)""")
def m6_tfidf_similarity(spark, sf):
    """M6 with TF-IDF weights of the documents instead of plain counts."""
    from ..operators.features import tfidf_similarity, train_idf
    from ..session import materialize
    idf = materialize(train_idf(docs(spark, sf)), "idf").select("idf").scalar()
    sims = stored_rewrites(spark, sf).withColumn("idf", idf).select("doc_id", r6(tfidf_similarity("text", "rewrite", F.col("idf"))).alias("sim"))
    return materialize(sims, "sims")


@register("m1_logistic_verdict", None)
def m1_logistic_verdict(spark, sf):
    """M1 as a logistic regression over hashed words, learned from the labels
    outside the fifth of the ids that is held out: the verdict on every
    document."""
    from ..operators.features import score_logistic, train_logistic
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train_logistic(labelled_docs(spark, sf).where(~held))
    return score_logistic(docs(spark, sf), model, out_col="p").select("doc_id", held.alias("held_out"), P.gate("p", THRESHOLD).alias("toxic"))


@register("m1_held_out", None)
def m1_held_out(spark, sf):
    """Both classifiers of M1, learned on the same labels, on the held-out fifth."""
    from ..operators.features import score_logistic, train_logistic
    from ..operators.metrics import confusion
    from ..operators.scoring import score_naive_bayes, train_naive_bayes
    lab = labelled_docs(spark, sf).where("toxic is not null")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    train, test = lab.where(~held), lab.where(held)
    weights, prior = train_naive_bayes(train)
    scored = {"naive_bayes": score_naive_bayes(test, weights, prior, "doc_id", out_col="p"), "logistic": score_logistic(test, train_logistic(train), out_col="p")}
    out = None
    for name, s in scored.items():
        c = confusion(s, "p", "toxic", THRESHOLD).select(F.lit(name).alias("model"), "tp", "fp", "tn", "fn", r6(F.col("accuracy")).alias("accuracy"))
        out = c if out is None else out.unionAll(c)
    return out


_CENTRES = ("SELECT {k}, coalesce(t[i - 1], '') AS l, t[i] AS w, coalesce(t[i + 1], '') AS r FROM "
            "(SELECT {k}, t, unnest(range(1, len(t) + 1)) AS i FROM {src})")
_PSEUDO_SQL = f"""rt AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents), rc AS ({_CENTRES.format(k='doc_id', src='rt').replace('t[i - 1]', 'CASE WHEN i > 1 THEN t[i - 1] END')}),
 c3 AS (SELECT l, w, r, count(*) AS c3 FROM rc GROUP BY ALL), clr AS (SELECT l, r, count(*) AS clr FROM rc GROUP BY ALL),
 clw AS (SELECT l, w, count(*) AS clw FROM rc GROUP BY ALL), cwr AS (SELECT w, r, count(*) AS cwr FROM rc GROUP BY ALL),
 cl AS (SELECT l, count(*) AS cl FROM rc GROUP BY ALL), cr AS (SELECT r, count(*) AS cr FROM rc GROUP BY ALL), v AS (SELECT count(DISTINCT w) AS v FROM rc),
 xt AS (SELECT doc_id, {_TOK.format('rewrite')} AS t FROM rw), xc AS ({_CENTRES.format(k='doc_id', src='xt').replace('t[i - 1]', 'CASE WHEN i > 1 THEN t[i - 1] END')}),
 pr AS (SELECT doc_id, -ln((coalesce(c3, 0) + ((coalesce(clw, 0) + 1) / (coalesce(cl, 0) + v) + (coalesce(cwr, 0) + 1) / (coalesce(cr, 0) + v)) / 2) / (coalesce(clr, 0) + 1)) AS nll
        FROM xc LEFT JOIN c3 USING (l, w, r) LEFT JOIN clr USING (l, r) LEFT JOIN clw USING (l, w) LEFT JOIN cwr USING (w, r) LEFT JOIN cl USING (l) LEFT JOIN cr USING (r), v),
 s AS (SELECT doc_id, sum(nll) AS nll, count(*) AS n FROM pr GROUP BY doc_id)"""


@register("m7_pseudo_perplexity",
          f"WITH {_RW_CTE}, {_PSEUDO_SQL} SELECT doc_id, round(CASE WHEN n >= 3 THEN exp(nll / n) END, 6) AS ppl FROM rw LEFT JOIN s USING (doc_id)")
def m7_pseudo_perplexity(spark, sf):
    """M7 with both neighbours of each word (pseudo-perplexity). The rewrites
    carry the documents' texts and are read once, into blocks: they are not
    stored before."""
    from ..operators.scoring import TwoSided, pseudo_nll, text_perplexity
    rewrites = gated_rewrites(spark, sf)
    nll = pseudo_nll(rewrites, TwoSided(rewrites, "text"), "doc_id", "rewrite")
    return text_perplexity(nll, "doc_id").select("doc_id", r6(F.col("ppl")).alias("ppl"))


@register("m8_evaluate",
          f"""{_BA_SQL}, {_bag_sql('rw', 'text', 'ba')}, {_bag_sql('rw', 'rewrite', 'bb')},
 dotp AS (SELECT doc_id, sum(ba.n * bb.n) AS d FROM ba JOIN bb USING (doc_id, w) GROUP BY doc_id),
 na AS (SELECT doc_id, sqrt(sum(n * n)) AS x FROM ba GROUP BY doc_id),
 nb AS (SELECT doc_id, sqrt(sum(n * n)) AS x FROM bb GROUP BY doc_id),
 sims AS (SELECT rw.doc_id, CASE WHEN na.x IS NULL OR nb.x IS NULL THEN 0.0
            ELSE coalesce(dotp.d, 0) / (na.x * nb.x) END AS sim
          FROM rw LEFT JOIN dotp USING (doc_id) LEFT JOIN na USING (doc_id) LEFT JOIN nb USING (doc_id)),
 {_nll_sql('rw', 'rewrite')[1:]},
 fl AS (SELECT doc_id, CASE WHEN n_tokens >= 3 THEN exp(nll_sum / n_pred) END AS ppl FROM nll),
 allm AS (SELECT ev.*, sims.sim, fl.ppl, l.toxic FROM ev JOIN sims USING (doc_id) JOIN fl USING (doc_id)
          LEFT JOIN labels l USING (doc_id))
 SELECT round(avg(CASE WHEN p_after < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS sta, round(avg(sim), 6) AS sim,
  round(avg(CASE WHEN NOT isnan(ppl) THEN ppl END), 6) AS fl,
  round(avg(CASE WHEN toxic IS NOT NULL THEN CASE WHEN (p_before >= 0.5)::INT = toxic THEN 1.0 ELSE 0.0 END END), 6)
   AS clf_acc, count(*) AS n_rows FROM allm""")
def m8_evaluate(spark, sf):
    """M8: STA of the rewrites, SIM(text, rewrite), FL = mean per-text
    perplexity of the rewrites, classifier accuracy on labelled rows."""
    from ..operators.metrics import evaluate
    from ..operators.scoring import evaluation_rows
    s = evaluation_rows(stored_rewrites(spark, sf), "doc_id", "text", "rewrite", nb_model(spark, sf), bigram_model(spark, sf),
                        read_table(spark, sf, "labels"), "toxic")
    m = evaluate(s, p_after="p_after", cos="cos", fluency="ppl", p_before="p_before", label="toxic",
                 threshold=THRESHOLD)
    return m.select(*[r6(F.col(c)).alias(c) for c in ("sta", "sim", "fl", "clf_acc")], "n_rows")


# ==========================================================================
# 7. sampling, splits, ids, alignment, caches
# ==========================================================================

SEED = 42
_H = "md5(concat('42:', doc_id::VARCHAR))"
_LABELLED = "documents JOIN labels USING (doc_id)"


def labelled_docs(spark, sf):
    return read_table(spark, sf, "documents").join(labels(spark, sf), "doc_id")


@register("o1_sample_per_class",
          f"SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER "
          f"(PARTITION BY toxic ORDER BY {_H}, doc_id) AS rn FROM {_LABELLED}) WHERE rn <= 20")
def o1_sample_per_class(spark, sf):
    from ..operators.sampling import sample_per_class
    s = sample_per_class(labelled_docs(spark, sf), "toxic", {1: 20, 0: 20}, "doc_id", SEED)
    return s.select("doc_id", "toxic")


@register("o2_train_val_split",
          f"SELECT doc_id, CASE WHEN rn <= ceil(n * 0.1) THEN 'val' ELSE 'train' END AS split FROM "
          f"(SELECT doc_id, row_number() OVER (ORDER BY {_H}, doc_id) AS rn, count(*) OVER () AS n FROM documents)")
def o2_train_val_split(spark, sf):
    from ..operators.sampling import train_val_split
    return train_val_split(read_table(spark, sf, "documents"), 0.1, "doc_id", SEED).select("doc_id", "split")


@register("o3_validation_slice",
          f"""WITH tr AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER
 (PARTITION BY toxic ORDER BY {_H}, doc_id) AS rn FROM {_LABELLED}) WHERE rn <= 20)
 SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tr) ORDER BY {_H}, doc_id LIMIT 50""")
def o3_validation_slice(spark, sf):
    from ..operators.sampling import sample_per_class, validation_slice
    train = sample_per_class(labelled_docs(spark, sf), "toxic", {1: 20, 0: 20}, "doc_id", SEED)
    return validation_slice(read_table(spark, sf, "documents"), train, "doc_id", 50, SEED).select("doc_id")


@register("o4_top_k",
          f"SELECT doc_id, {S.term_hits('text', TERMS)} AS hits FROM documents "
          f"ORDER BY hits DESC, doc_id LIMIT 10")
def o4_top_k(spark, sf):
    from ..operators.select import top_k
    d = docs(spark, sf).select("doc_id", P.term_hits("text", TERMS).alias("hits"))
    return top_k(d, "hits", 10, ["doc_id"])


@register("o5_limit_head", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 15")
def o5_limit_head(spark, sf):
    from ..operators.select import limit_head
    return limit_head(read_table(spark, sf, "documents").select("doc_id", "lang"), 15, ["doc_id"])


def langs(spark, sf) -> list:
    """The languages of the documents in order (one short value each)."""
    return [r.lang for r in read_table(spark, sf, "documents").select("lang").distinct().orderBy("lang").collect()]


_PART = "CAST(dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS INTEGER)"


@register("u1_union_parts", f"SELECT doc_id, {_PART} AS part FROM documents")
def u1_union_parts(spark, sf):
    from ..operators.sampling import union_parts
    d = read_table(spark, sf, "documents").select("doc_id", "lang")
    return union_parts([d.where(F.col("lang").eqNullSafe(l)) for l in langs(spark, sf)], "part").select("doc_id", "part")


@register("u2_contiguous_split",
          "SELECT doc_id, least(floor((rn - 1) / (n // 3)), 2)::INT AS part FROM "
          "(SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn, count(*) OVER () AS n FROM documents)")
def u2_contiguous_split(spark, sf):
    from ..operators.sampling import contiguous_split
    return contiguous_split(read_table(spark, sf, "documents").select("doc_id"), 3, ["doc_id"]).select("doc_id", "part")


@register("u4_dense_id",
          "SELECT doc_id, (row_number() OVER (ORDER BY lang, doc_id) - 1)::BIGINT AS idx FROM documents")
def u4_dense_id(spark, sf):
    from ..operators.sampling import dense_id
    return dense_id(read_table(spark, sf, "documents").select("doc_id", "lang"), ["lang", "doc_id"], "idx") \
        .select("doc_id", "idx")


@register("j2_align_positional",
          """SELECT d.doc_id, coalesce(b.text, '') AS bench_text FROM
 (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents) d LEFT JOIN
 (SELECT text, row_number() OVER (ORDER BY item_id) AS p FROM benchmark) b USING (p)""")
def j2_align_positional(spark, sf):
    from ..operators.sampling import align_positional
    d = read_table(spark, sf, "documents").select("doc_id")
    b = read_table(spark, sf, "benchmark").select("item_id", F.col("text").alias("bench_text"))
    return align_positional(d, b, ["doc_id"], ["item_id"], ["bench_text"]).select("doc_id", "bench_text")


_C1_SQL = S.nested_replace("text", TERMS)


@register("j3_with_cache",
          f"""WITH cache AS (SELECT sha256(text) AS key, min(concat('cached:', {_C1_SQL})) AS value
   FROM {_LABELLED} GROUP BY 1)
 SELECT doc_id, coalesce(c.value, concat('fresh:', {_C1_SQL})) AS out
 FROM documents LEFT JOIN cache c ON sha256(text) = c.key""")
def j3_with_cache(spark, sf):
    """Results cached for the labelled documents (keyed by content hash)
    are reused; the rest are computed once per distinct text."""
    from ..operators.gate import content_key, with_cache
    cache = labelled_docs(spark, sf).select(content_key("text").alias("key"),
                                            F.concat(F.lit("cached:"), T.remove_literals("text", TERMS)).alias("value"))

    def compute(m):
        return m.withColumn("value", F.concat(F.lit("fresh:"), T.remove_literals("text", TERMS)))
    res, _fresh = with_cache(docs(spark, sf), cache, "text", "out", compute)
    return res.select("doc_id", "out")


# ==========================================================================
# 9. vectors on embeddings: label // 2 acts as the layer, label % 2 as the
#    class (1 = toxic), so every row takes part.
# ==========================================================================

LAYER_SQL = "(label // 2)"
CLASS_SQL = "(label % 2)"
ALPHAS = [0.5, 1.0, 2.0]


def emb(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.withColumn("layer", (F.col("label") / 2).cast("int")).withColumn("cls", F.col("label") % 2)


_UNNEST = ("SELECT vec_id, label, {l} AS layer, {c} AS cls, unnest(embedding)::DOUBLE AS x, "
           "unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings").format(l=LAYER_SQL, c=CLASS_SQL)


def _explode_means(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by, F.posexplode("mean").alias("pos0", "m")) \
        .select(*by, (F.col("pos0") + 1).alias("pos"), r6(F.col("m")).alias("mean"))


@register("a8_class_means",
          f"SELECT label, pos::INTEGER AS pos, round(avg(x), 6) AS mean FROM ({_UNNEST}) GROUP BY label, pos")
def a8_class_means(spark, sf):
    from ..operators.vectors import class_means
    return _explode_means(class_means(read_table(spark, sf, "embeddings"), "embedding", ["label"]), ["label"])


@register("a9_layer_means",
          f"SELECT layer, cls, pos::INTEGER AS pos, round(avg(x), 6) AS mean FROM ({_UNNEST}) GROUP BY layer, cls, pos")
def a9_layer_means(spark, sf):
    from ..operators.vectors import class_means
    return _explode_means(class_means(emb(spark, sf), "embedding", ["layer", "cls"]), ["layer", "cls"])


_MEANS_SQL = f"means AS (SELECT layer, cls, pos, avg(x) AS m FROM ({_UNNEST}) GROUP BY layer, cls, pos)"
_DELTA_SQL = ("delta AS (SELECT n.layer, n.pos, n.m - p.m AS d FROM means n JOIN means p "
              "ON n.layer = p.layer AND n.pos = p.pos AND n.cls = 0 AND p.cls = 1)")


@register("v3_diff_in_means",
          f"WITH {_MEANS_SQL}, {_DELTA_SQL} SELECT layer, pos::INTEGER AS pos, round(d, 6) AS delta FROM delta")
def v3_diff_in_means(spark, sf):
    from ..operators.vectors import class_means, diff_in_means
    m = class_means(emb(spark, sf), "embedding", ["layer", "cls"])
    d = diff_in_means(m, "cls", ["layer"])
    return d.select("layer", F.posexplode("delta").alias("pos0", "v")) \
        .select("layer", (F.col("pos0") + 1).alias("pos"), r6(F.col("v")).alias("delta"))


@register("v1_cosine_to_mean",
          f"""WITH {_MEANS_SQL}, e AS ({_UNNEST}),
 j AS (SELECT e.vec_id, sum(e.x * m.m) AS d, sqrt(sum(e.x * e.x)) AS a, sqrt(sum(m.m * m.m)) AS b
       FROM e JOIN means m ON e.layer = m.layer AND e.cls = m.cls AND e.pos = m.pos GROUP BY e.vec_id)
 SELECT vec_id, round(CASE WHEN a * b > 0 THEN d / (a * b) ELSE 0.0 END, 6) AS cos FROM j""")
def v1_cosine_to_mean(spark, sf):
    """V1: cosine of every vector with the mean of its (layer, class); the
    means table is broadcast if its stored size allows it."""
    from ..operators.vectors import class_means, cosine
    from ..session import broadcast_if_small, materialize
    e = emb(spark, sf)
    m = materialize(class_means(e, "embedding", ["layer", "cls"]).select("layer", "cls", "mean"), "class-means")
    return e.join(broadcast_if_small(m), ["layer", "cls"]).select("vec_id", r6(cosine("embedding", "mean")).alias("cos"))


@register("v4_shift_norm",
          f"""WITH {_MEANS_SQL}, {_DELTA_SQL}, e AS ({_UNNEST})
 SELECT vec_id, round(sqrt(sum((e.x - 1.0 * delta.d) * (e.x - 1.0 * delta.d))), 6) AS shifted_norm
 FROM e JOIN delta ON e.layer = delta.layer AND e.pos = delta.pos GROUP BY vec_id""")
def v4_shift_norm(spark, sf):
    from ..operators.vectors import class_means, diff_in_means, norm, shift
    from ..session import broadcast_if_small, materialize
    e = emb(spark, sf)
    d = materialize(diff_in_means(class_means(e, "embedding", ["layer", "cls"]), "cls", ["layer"]).select("layer", "delta"), "deltas")
    return e.join(broadcast_if_small(d), "layer").select("vec_id", r6(norm(shift("embedding", "delta", 1.0))).alias("shifted_norm"))


_GRID_SQL = "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {l}, {a}::DOUBLE)" for i, (l, a) in enumerate((l, a) for l in range(5) for a in ALPHAS)) + \
    ") AS g(grid_order, layer, alpha))"


@register("j5_param_grid",
          f"WITH {_GRID_SQL} SELECT g.grid_order, g.layer, g.alpha, count(*) AS n FROM grid g "
          f"JOIN embeddings e ON {LAYER_SQL.replace('label', 'e.label')} = g.layer GROUP BY ALL")
def j5_param_grid(spark, sf):
    from ..operators.vectors import param_grid
    g = param_grid(spark, list(range(5)), ALPHAS)
    # the grid is user-given (layers x alphas): bounded, broadcast
    return emb(spark, sf).select("layer").join(F.broadcast(g), "layer").groupBy("grid_order", "layer", "alpha") \
        .agg(F.count("*").alias("n"))


_M9_SQL = f"""WITH {_GRID_SQL}, {_MEANS_SQL}, {_DELTA_SQL}, e AS ({_UNNEST}),
 s AS (SELECT g.grid_order, g.layer, g.alpha, e.vec_id, e.pos, e.x, e.x - g.alpha * delta.d AS y,
              mn.m AS mneg, mp.m AS mpos
       FROM grid g JOIN e ON e.layer = g.layer JOIN delta ON delta.layer = g.layer AND delta.pos = e.pos
       JOIN means mn ON mn.layer = g.layer AND mn.pos = e.pos AND mn.cls = 0
       JOIN means mp ON mp.layer = g.layer AND mp.pos = e.pos AND mp.cls = 1),
 v AS (SELECT grid_order, layer, alpha, vec_id,
   sum(y * mneg) / nullif(sqrt(sum(y * y)) * sqrt(sum(mneg * mneg)), 0) AS cn,
   sum(y * mpos) / nullif(sqrt(sum(y * y)) * sqrt(sum(mpos * mpos)), 0) AS cp,
   coalesce(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 0.0) AS cs
   FROM s GROUP BY ALL),
 cands AS (SELECT grid_order, layer, alpha, avg(CASE WHEN coalesce(cn, 0.0) > coalesce(cp, 0.0) THEN 1.0 ELSE 0.0 END) AS sta,
   avg(cs) AS sim, count(*) AS n FROM v GROUP BY ALL)"""


def _grid(spark, sf):
    from ..operators.vectors import class_means, grid_search, param_grid
    from ..session import materialize
    e = emb(spark, sf)
    m = materialize(class_means(e, "embedding", ["layer", "cls"]), "class-means")
    return grid_search(e, m, param_grid(spark, list(range(5)), ALPHAS), "layer", "embedding", "cls", k=2)


@register("m9_grid_search",
          f"{_M9_SQL} SELECT grid_order, layer, alpha, round(sta, 6) AS sta, round(sim, 6) AS sim, "
          "round(sta + 0.5 * sim, 6) AS score, n FROM cands")
def m9_grid_search(spark, sf):
    cands, _top = _grid(spark, sf)
    return cands.select("grid_order", "layer", "alpha", r6(F.col("sta")).alias("sta"), r6(F.col("sim")).alias("sim"),
                        r6(F.col("score")).alias("score"), "n")


@register("o4_grid_top2",
          f"{_M9_SQL} SELECT grid_order, layer, alpha FROM cands ORDER BY sta + 0.5 * sim DESC, grid_order LIMIT 2")
def o4_grid_top2(spark, sf):
    _c, top = _grid(spark, sf)
    return top.select("grid_order", "layer", "alpha")


# ==========================================================================
# 8. best of N over three derived candidate rewrites per document
# ==========================================================================

def _attempts():
    return F.array(F.concat(F.lit(PROMPT), "text"), T.cleanse("text", TERMS, PATTERNS),
                   T.truncate_tokens("text", 12))


_ATTEMPTS_SQL = [f"concat({S.q(PROMPT)}, text)", _C4_SQL,
                 f"array_to_string(({S.split_ws('text')})[1:12], ' ')"]


def _ok(x: str) -> str:
    return f"({x} IS NOT NULL AND length({S.strip(x)}) >= 3)"


def _o6_sql(src: str = "documents") -> str:
    raws = " UNION ALL ".join(f"SELECT doc_id, {i + 1} AS attempt, {a} AS g, text AS s FROM {src}"
                              for i, a in enumerate(_ATTEMPTS_SQL))
    overlap = (f"(len(list_intersect(list_distinct({S.split_ws('lower(s)')}), "
               f"list_distinct({S.split_ws('lower(g2)')}))) / "
               f"greatest(len(list_distinct({S.split_ws('lower(s)')})), 1))")
    return f"""WITH raw AS ({raws}),
 gen AS MATERIALIZED (SELECT doc_id, attempt, s, {_c14_sql('g', 's')} AS gen FROM raw),
 flt AS MATERIALIZED (SELECT doc_id, attempt, s, gen, {S.filter_tokens('gen', TERMS, REPLACEMENTS)} AS f FROM gen),
 att AS (SELECT doc_id, attempt, s, CASE WHEN {_ok('f')} THEN f ELSE gen END AS g2 FROM flt),
 sc AS MATERIALIZED (SELECT doc_id, attempt, s, g2, {_ok('g2')} AS ok,
   {_valid_sql('g2', 's').replace('text', 's')} AS valid,
   10.0 * {S.term_hits('g2', TERMS)} - 5.0 * {overlap} AS score FROM att),
 s1 AS (SELECT doc_id, min(attempt) FILTER (WHERE ok) AS f_t,
   first(score ORDER BY attempt) FILTER (WHERE ok) AS s_f,
   min(attempt) FILTER (WHERE valid) AS v_any,
   min(attempt) FILTER (WHERE valid AND score <= 0) AS v_neg FROM sc GROUP BY doc_id),
 k AS (SELECT doc_id, f_t, CASE WHEN s_f <= 0 THEN v_any ELSE v_neg END AS k_t FROM s1),
 win AS (SELECT sc.doc_id, first(g2 ORDER BY score, attempt) FILTER (WHERE
     (attempt = f_t OR (valid AND attempt > f_t)) AND (k_t IS NULL OR attempt <= k_t)) AS w
   FROM sc JOIN k USING (doc_id) GROUP BY sc.doc_id),
 soft AS MATERIALIZED (SELECT d.doc_id, d.text, win.w, {S.filter_tokens('d.text', TERMS, REPLACEMENTS)} AS ft
   FROM {src} d LEFT JOIN win USING (doc_id)),
 res AS MATERIALIZED (SELECT doc_id, text, w,
   CASE WHEN NOT {_ok('w')} OR NOT coalesce({_valid_sql('w', 'text')}, false) THEN
     CASE WHEN {_ok('ft')} THEN ft ELSE {S.drop_toxic('text', TERMS)} END
   ELSE w END AS r FROM soft),
 fin AS (SELECT doc_id, text, CASE WHEN r IS NULL OR r = '' THEN r
   ELSE {S.filter_tokens(S.collapse('r'), TERMS, REPLACEMENTS)} END AS b FROM res)
 SELECT doc_id, CASE WHEN {_ok('b')} THEN b ELSE text END AS best FROM fin"""


_O6_SQL = _o6_sql()


@register("o6_best_of_n", _O6_SQL)
def o6_best_of_n(spark, sf):
    """O6 with the attempts of a document in one array (no shuffle)."""
    from ..operators.select import best_of_n
    d = docs(spark, sf)
    return d.select("doc_id", best_of_n(_attempts(), F.col("text"), TERMS, REPLACEMENTS, PROMPT).alias("best"))


@register("o6_best_of_n_grouped", _O6_SQL)
def o6_best_of_n_grouped(spark, sf):
    """O6 on a long candidates table (doc_id, attempt, gen): two aggregations
    by key instead of collecting a key's attempts."""
    from ..operators.select import best_of_n_grouped
    d = docs(spark, sf)
    long = d.select("doc_id", "text", F.posexplode(_attempts()).alias("attempt", "gen"))
    return best_of_n_grouped(long, "doc_id", "attempt", "gen", "text", TERMS, REPLACEMENTS, PROMPT) \
        .select("doc_id", "best")


# ==========================================================================
# 10. Python model stages (M2-M5) with deterministic stand-in models
# ==========================================================================

_ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
_ASCII_UPPER = _ASCII_LOWER.upper()


def ascii_upper_model():
    """Stand-in 'forward translator': ASCII letters to upper case."""
    table = str.maketrans(_ASCII_LOWER, _ASCII_UPPER)
    return lambda xs: [None if x is None else x.translate(table) for x in xs]


def ascii_lower_model():
    """Stand-in 'back translator': ASCII letters to lower case."""
    table = str.maketrans(_ASCII_UPPER, _ASCII_LOWER)
    return lambda xs: [None if x is None else x.translate(table) for x in xs]


def drop_marked_words_model():
    """Stand-in 'editor': removes every whitespace token holding ORAN."""
    import re
    rx = re.compile(r"\S*ORAN\S*")
    return lambda xs: [None if x is None else rx.sub("", x) for x in xs]


_UP = f"translate(text, {S.q(_ASCII_LOWER)}, {S.q(_ASCII_UPPER)})"


@register("m2_batch_map", f"SELECT doc_id, {_UP} AS out FROM documents")
def m2_batch_map(spark, sf):
    from ..operators.gate import batch_map
    d = docs(spark, sf).select("doc_id", "text")
    return batch_map(d, ascii_upper_model, "text", "out", batch_size=16).select("doc_id", "out")


@register("m3_first_available", f"SELECT doc_id, {_UP} AS out FROM documents")
def m3_first_available(spark, sf):
    """M3: the first backend fails to load on the executor, the second is used."""
    from ..operators.gate import batch_map, first_available

    def broken():
        raise ImportError("backend not installed")
    d = docs(spark, sf).select("doc_id", "text")
    return batch_map(d, first_available([broken, ascii_upper_model]), "text", "out").select("doc_id", "out")


_PIVOT_SQL = (f"CASE WHEN {S.term_hits('text', TERMS)} >= 1 THEN translate(regexp_replace({_UP}, "
              rf"'\S*ORAN\S*', '', 'g'), {S.q(_ASCII_UPPER)}, {S.q(_ASCII_LOWER)}) ELSE text END")


@register("m4_pivot_edit", f"SELECT doc_id, {_PIVOT_SQL} AS out FROM documents")
def m4_pivot_edit(spark, sf):
    """M4: forward, edit and back stages run only on gated rows, in one
    Arrow hop; ungated rows keep their text."""
    from ..operators.gate import pivot_edit
    d = docs(spark, sf).select("doc_id", "text", P.term_hits("text", TERMS).alias("hits"))
    return pivot_edit(d, F.col("hits") >= 1, "text", "out", ascii_upper_model, drop_marked_words_model,
                      ascii_lower_model).select("doc_id", "out")


def _stage_caches(spark, names) -> dict:
    import uuid

    from ..operators.caches import BucketedCache
    tag = uuid.uuid4().hex[:12]
    return {n: BucketedCache(spark, f"textguard_{n}_{tag}", 8) for n in names}


_STAGES = ("forward", "edit", "back")


@register("m4_cached_stages", f"SELECT doc_id, {_PIVOT_SQL} AS out FROM documents")
def m4_cached_stages(spark, sf):
    """M4 with a bucketed cache before each of the three models. The first run
    fills the caches from the labelled documents, they are compacted, and the
    second one asks the models for the other texts alone."""
    from ..operators.caches import cached_stages
    caches = _stage_caches(spark, _STAGES)
    stages = list(zip(_STAGES, (ascii_upper_model, drop_marked_words_model, ascii_lower_model), strict=True))
    hits = P.term_hits("text", TERMS) >= 1
    first = cached_stages(labelled_docs(spark, sf).select("doc_id", "text"), hits, "text", "out", stages, caches)
    first.write.format("noop").mode("overwrite").save()
    for c in caches.values():
        c.compact()
    return cached_stages(docs(spark, sf).select("doc_id", "text"), hits, "text", "out", stages, caches).select("doc_id", "out")


@register("s12_stream_cached_stages", f"SELECT doc_id, {_PIVOT_SQL} AS out FROM documents")
def s12_stream_cached_stages(spark, sf):
    """M4 with its caches on a stream of the documents."""
    from ..streaming.stream import documents_stream, run_pivot_stream
    stages = list(zip(_STAGES, (ascii_upper_model, drop_marked_words_model, ascii_lower_model), strict=True))
    out = run_pivot_stream(spark, documents_stream(spark, sf).select("doc_id", "text"), P.term_hits("text", TERMS) >= 1, "text", "out",
                           stages, _stage_caches(spark, _STAGES), _scratch(spark, "pivot-stream"))
    return out.select("doc_id", "out")


_RT = f"translate({_UP}, {S.q(_ASCII_UPPER)}, {S.q(_ASCII_LOWER)})"


@register("m5_round_trip",
          f"SELECT doc_id, rt AS roundtrip, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS overlap "
          f"FROM (SELECT doc_id, {_RT} AS rt, list_distinct({S.split_ws('lower(text)')}) AS a, "
          f"list_distinct({S.split_ws('lower(' + _RT + ')')}) AS b FROM documents)")
def m5_round_trip(spark, sf):
    """M5: text -> forward -> back, with the word-overlap drift per row."""
    from ..operators.gate import round_trip
    d = docs(spark, sf).select("doc_id", "text")
    r = round_trip(d, "text", ascii_upper_model, ascii_lower_model)
    return r.select("doc_id", "roundtrip", r6(P.word_overlap("text", "roundtrip")).alias("overlap"))


# ==========================================================================
# 11. streaming: the gated flow on a file stream (availableNow)
# ==========================================================================

@register("s11_stream_gated_edit", f"SELECT doc_id, rewrite, edited FROM ({_g1_sql()})")
def s11_stream_gated_edit(spark, sf):
    """The flagship gated flow as a Structured Streaming query over the
    documents files; runs to completion with ``availableNow`` into a Parquet
    sink under the shared checkpoint folder, then reads the sink."""
    from ..streaming.stream import run_gated_stream
    return run_gated_stream(spark, sf, TERMS, PATTERNS)


# ==========================================================================
# 12. merge by key, class filter, repair, pooling and probabilities
# ==========================================================================

@register("j1_merge_edits",
          f"""WITH e AS (SELECT doc_id, {S.drop_toxic('text', TERMS)} AS ed FROM documents
            WHERE {S.term_hits('text', TERMS)} >= 1)
 SELECT d.doc_id, coalesce(e.ed, d.text) AS out FROM documents d LEFT JOIN e USING (doc_id)""")
def j1_merge_edits(spark, sf):
    """Edits produced for the gated rows only (as an external editor
    would return them) are merged back by key; other rows keep the text."""
    from ..operators.gate import merge_edits
    d = docs(spark, sf)
    edits = d.where(P.term_hits("text", TERMS) >= 1).select("doc_id", T.drop_toxic_tokens("text", TERMS).alias("ed"))
    return merge_edits(d, edits, "doc_id", "text", "ed", "out").select("doc_id", "out")


@register("p3_class_filter", f"SELECT doc_id FROM {_LABELLED} WHERE toxic = 1")
def p3_class_filter(spark, sf):
    from ..operators.sampling import class_filter
    return class_filter(labelled_docs(spark, sf), "toxic", 1).select("doc_id")


@register("g3_repair",
          rf"""SELECT CAST(doc_id AS VARCHAR) AS ID, text AS tat_toxic,
 CASE WHEN r IS NULL OR regexp_matches(r, '^\s*$') THEN text ELSE r END AS tat_detox1
 FROM (SELECT doc_id, text, {_LATIN_DROPPED} AS r FROM documents)""")
def g3_repair(spark, sf):
    """G3 on a rewrite column that is blank for many rows (Latin tokens
    dropped): id as string, columns in order, blanks from the source."""
    from ..operators.gate import repair
    d = docs(spark, sf).select(F.col("doc_id").alias("ID"), F.col("text").alias("tat_toxic"),
                               T.drop_tokens_matching("text").alias("tat_detox1"))
    return repair(d, "ID", "tat_toxic", "tat_detox1")


@register("v2_last_token",
          "SELECT vec_id, round(embedding[list_max(list_filter(list_transform(embedding, "
          "lambda lx_, li_: CASE WHEN lx_ > 0 THEN li_ END), lambda lp_: lp_ IS NOT NULL))]::DOUBLE, 6) "
          "AS last_value FROM embeddings")
def v2_last_token(spark, sf):
    """V2 with the sign of each component as the mask: the value at the last
    position whose mask is 1."""
    from ..operators.vectors import last_token
    e = read_table(spark, sf, "embeddings")
    mask = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0))
    return e.select("vec_id", r6(last_token(F.col("embedding"), mask).cast("double")).alias("last_value"))


@register("v5_prob_class1",
          "SELECT vec_id, round(1.0 / (1.0 + exp(embedding[1]::DOUBLE - embedding[2]::DOUBLE)), 6) AS p1 "
          "FROM embeddings")
def v5_prob_class1(spark, sf):
    """V5: the first two components read as two-class logits."""
    from ..operators.vectors import prob_class1
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", r6(prob_class1("embedding")).alias("p1"))


# ==========================================================================
# 13. sinks and sources: round trips through the shared checkpoint folder
# ==========================================================================

def _scratch(spark, name: str) -> str:
    import os
    import uuid

    from ..session import ensure_checkpoint_dir
    return os.path.join(ensure_checkpoint_dir(spark), "io", f"{name}-{uuid.uuid4().hex}")


@register("k1_s2_tsv_round_trip",
          f"SELECT CAST(doc_id AS VARCHAR) AS ID, text AS tat_toxic, nullif({_C4_SQL}, '') AS tat_detox1 "
          "FROM documents")
def k1_s2_tsv_round_trip(spark, sf):
    """K1 writes the rewrite table (ID, tat_toxic, tat_detox1) as quoted TSV
    (texts hold newlines and quotes); S2 reads it back. An empty field reads
    back as null."""
    from ..sources import io as IO
    path = _scratch(spark, "rewrites")
    d = docs(spark, sf).select("doc_id", "text", T.cleanse("text", TERMS, PATTERNS).alias("c"))
    IO.write_rewrites(d, path, id_col="doc_id", source="text", rewrite="c")
    return IO.read_tsv(spark, path, required=IO.REWRITE_COLUMNS, quoted=True)


@register("s5_read_parts",
          f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, {_PART} AS part, text FROM documents")
def s5_read_parts(spark, sf):
    """One quoted TSV part per language, written in one pass, read back
    stacked in part order."""
    from ..sources import io as IO
    found = langs(spark, sf)
    root = _scratch(spark, "parts")
    part = F.array_position(F.array(*[F.lit(x) for x in found if x is not None]), F.col("lang")) - (0 if None in found else 1)
    d = docs(spark, sf).select("doc_id", "text", F.coalesce(part, F.lit(0)).cast("int").alias("part"))
    IO.write_tsv(d, root, partition_by="part")
    return IO.read_parts(spark, [f"{root}/part={i}" for i in range(len(found))], quoted=True).select("doc_id", "part", "text")


@register("k3_metrics_json_round_trip",
          "SELECT lang, round(avg(length(text)), 6) AS avg_len, count(*) AS n_rows FROM documents GROUP BY lang")
def k3_metrics_json_round_trip(spark, sf):
    """K3: a metrics frame written as JSON lines and read back."""
    from ..sources import io as IO
    path = _scratch(spark, "metrics")
    m = docs(spark, sf).groupBy("lang").agg(r6(F.avg(F.length("text"))).alias("avg_len"),
                                            F.count("*").alias("n_rows"))
    IO.write_metrics_json(m, path)
    return spark.read.schema("lang string, avg_len double, n_rows long").json(path)


@register("k4_cache_round_trip",
          f"""WITH cache AS (SELECT sha256(text) AS key, min(concat('cached:', {_C1_SQL})) AS value
   FROM {_LABELLED} GROUP BY 1)
 SELECT doc_id, coalesce(c.value, concat('fresh:', {_C1_SQL})) AS out
 FROM documents LEFT JOIN cache c ON sha256(text) = c.key""")
def k4_cache_round_trip(spark, sf):
    """K4 + J3: cached results are written as a keyed Parquet cache
    (partitioned by stage), read back and reused; misses are computed and
    appended to it, and a second run computes nothing."""
    from ..operators.gate import content_key, with_cache
    from ..sources import io as IO
    path = _scratch(spark, "cache")
    seed = labelled_docs(spark, sf).select(content_key("text").alias("key"),
                                           F.concat(F.lit("cached:"), T.remove_literals("text", TERMS)).alias("value"))
    IO.write_cache(seed, path, stage="clean")
    cache = IO.read_cache(spark, path, stage="clean")

    def compute(m):
        return m.withColumn("value", F.concat(F.lit("fresh:"), T.remove_literals("text", TERMS)))
    with_cache(docs(spark, sf), cache, "text", "out", compute, save_to=path, stage="clean")
    # a second run finds every text in the saved cache

    def nothing(m):
        return m.withColumn("value", F.raise_error(F.lit("computed again")).cast("string"))
    res, _none = with_cache(docs(spark, sf), IO.read_cache(spark, path, stage="clean"), "text", "out", nothing)
    return res.select("doc_id", "out")


@register("k5_s6_vector_bundle_round_trip",
          f"WITH {_MEANS_SQL}, {_DELTA_SQL} SELECT layer, pos::INTEGER AS pos, round(d::FLOAT::DOUBLE, 6) AS delta "
          "FROM delta")
def k5_s6_vector_bundle_round_trip(spark, sf):
    """K5 writes one diff-in-means bundle per layer (vector + meta); S6
    reads them back (layer from the meta) and the vectors are compared."""
    from ..operators.vectors import class_means, diff_in_means
    from ..sources import io as IO
    path = _scratch(spark, "bundle")
    m = class_means(emb(spark, sf), "embedding", ["layer", "cls"])
    d = diff_in_means(m, "cls", ["layer"])
    bundle = d.select(F.col("delta").cast("array<float>").alias("vector"),
                      F.struct(F.lit("embeddings").alias("model_id"), F.col("layer").alias("layer_idx"),
                               F.col("n_pos").cast("int").alias("n_toxic"), F.col("n_neg").cast("int").alias("n_nontoxic"),
                               F.lit(64).alias("max_length")).alias("meta"))
    IO.write_vector_bundle(bundle, path)
    back = IO.read_vector_bundle(spark, path, default_layer=-1)
    return back.select("layer", F.posexplode("vector").alias("pos0", "v")) \
        .select("layer", (F.col("pos0") + 1).alias("pos"), r6(F.col("v").cast("double")).alias("delta"))


@register("c18_apply_to_columns",
          f"SELECT conv_id, turn, {_c11_sql('role')} AS role, {_c11_sql(_C11_IN_SQL)} AS text FROM conversations")
def c18_apply_to_columns(spark, sf):
    """One cleaning function over a list of columns (an unknown name is
    warned about and skipped), C19 keeps the output columns in order."""
    import warnings

    from ..operators.columns import apply_to_columns, select_ordered
    d = convs(spark, sf).withColumn("text", _c11_in())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        out = apply_to_columns(d, "role, text, tat_detox1", T.strip_prompt_artifacts)
    return select_ordered(out, ["conv_id", "turn", "role", "text"])[0]


# ==========================================================================
# 14. end-to-end flows (plans/flows.py)
# ==========================================================================

def _c8_expr(col: str) -> str:
    """C8 of an arbitrary column as a scalar subquery."""
    full = S.normalize_punct(_rules_sql(col, RULES))
    light = S.normalize_punct(_rules_sql(col, FALLBACK_RULES))
    return (rf"(SELECT coalesce(trim(CASE WHEN r_full = '' OR length(trim(r_full)) < 2 THEN "
            rf"(CASE WHEN r_light IS NULL OR regexp_matches(r_light, '^\s*$') THEN {col} ELSE r_light END) "
            rf"ELSE r_full END), '') FROM (SELECT {full} AS r_full, {light} AS r_light))")


_E1_SQL = f"""WITH cl AS (SELECT doc_id, text, {_C4_SQL} AS cleaned FROM documents),
 {_nb_score_sql('cl', 'cleaned')},
 ed AS (SELECT cl.doc_id, cl.text, scored.p >= 0.5 AS edited,
   CASE WHEN scored.p >= 0.5 THEN {S.drop_toxic('cl.cleaned', TERMS)} ELSE cl.cleaned END AS o
   FROM cl JOIN scored USING (doc_id))
 SELECT doc_id, edited, CASE WHEN o IS NULL OR regexp_matches(o, '^\\s*$') THEN text ELSE o END AS rewrite FROM ed"""


@register("e1_clean_gate_edit", _E1_SQL)
def e1_clean_gate_edit(spark, sf):
    """Clean -> naive Bayes score of the cleaned text -> gate at 0.5 ->
    C9b editor on gated rows -> fallback to the source."""
    from .flows import clean_gate_edit, nb_scorer
    w, prior = nb_model(spark, sf)
    out = clean_gate_edit(docs(spark, sf), "doc_id", "text", TERMS, PATTERNS, nb_scorer(w, prior, "doc_id"),
                          THRESHOLD, editor=lambda c: T.drop_toxic_tokens(c, TERMS))
    return out.select("doc_id", "edited", "rewrite")


_PIVOT_GEN = (f"translate(regexp_replace(translate(text, {S.q(_ASCII_LOWER)}, {S.q(_ASCII_UPPER)}), "
              rf"'\S*ORAN\S*', '', 'g'), {S.q(_ASCII_UPPER)}, {S.q(_ASCII_LOWER)})")

_E2_SQL = f"""WITH {_nb_score_sql('documents', 'text', 'b')},
 gen AS (SELECT d.doc_id, d.text, sb.p AS p_before, sb.p >= 0.5 AS edited,
   CASE WHEN sb.p >= 0.5 THEN {_PIVOT_GEN} ELSE d.text END AS g0
   FROM documents d JOIN scoredb sb USING (doc_id)),
 gen2 AS (SELECT doc_id, text, p_before, edited,
   CASE WHEN g0 IS NULL OR regexp_matches(g0, '^\\s*$') THEN text ELSE g0 END AS generated FROM gen),
 {_nb_score_sql('gen2', 'generated', 'a', with_model=False)},
 {_bag_sql('gen2', 'text', 'ba')}, {_bag_sql('gen2', 'generated', 'bb')},
 dotp AS (SELECT doc_id, sum(ba.n * bb.n) AS d FROM ba JOIN bb USING (doc_id, w) GROUP BY doc_id),
 na AS (SELECT doc_id, sqrt(sum(n * n)) AS x FROM ba GROUP BY doc_id),
 nb AS (SELECT doc_id, sqrt(sum(n * n)) AS x FROM bb GROUP BY doc_id),
 {_nll_sql('gen2', 'generated')[1:]},
 ev AS (SELECT gen2.doc_id, sa.p AS p_after, CASE WHEN na.x IS NULL OR nb.x IS NULL THEN 0.0
          ELSE coalesce(dotp.d, 0) / (na.x * nb.x) END AS cos, gen2.p_before, l.toxic,
          CASE WHEN n_tokens >= 3 THEN exp(nll_sum / n_pred) END AS ppl
        FROM gen2 JOIN scoreda sa USING (doc_id) LEFT JOIN dotp USING (doc_id)
        LEFT JOIN na USING (doc_id) LEFT JOIN nb USING (doc_id) JOIN nll USING (doc_id) LEFT JOIN labels l USING (doc_id))
 SELECT round(avg(CASE WHEN p_after < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS sta, round(avg(cos), 6) AS sim,
   round(avg(CASE WHEN NOT isnan(ppl) THEN ppl END), 6) AS fl,
   round(avg(CASE WHEN toxic IS NOT NULL THEN CASE WHEN (p_before >= 0.5)::INT = toxic THEN 1.0 ELSE 0.0 END END), 6) AS clf_acc,
   count(*) AS n_rows FROM ev"""


@register("e2_pivot_with_metrics", _E2_SQL)
def e2_pivot_with_metrics(spark, sf):
    """Score the raw text, gate, forward -> edit -> back on gated rows
    (stand-in models), rescore; STA, SIM and fluency of the result and the
    classifier's accuracy on the labelled rows."""
    from .flows import bigram_fluency, nb_scorer, pivot_with_metrics
    w, prior = nb_model(spark, sf)
    _rows, m, _ = pivot_with_metrics(_with_labels(spark, sf), "doc_id", "text",
                                     nb_scorer(w, prior, "doc_id"), ascii_upper_model, drop_marked_words_model,
                                     ascii_lower_model, THRESHOLD, label="toxic",
                                     fluency=bigram_fluency(bigram_model(spark, sf), "doc_id"))
    return m.select(*[r6(F.col(c)).alias(c) for c in ("sta", "sim", "fl", "clf_acc")], "n_rows")


def _with_labels(spark, sf):
    """Documents with their toxicity label, null where there is none."""
    return docs(spark, sf).select("doc_id", "text").join(labels(spark, sf).select("doc_id", "toxic"), "doc_id", "left")


@register("e2_pivot_cached", _E2_SQL)
def e2_pivot_cached(spark, sf):
    """E2 with a forward-translation cache seeded from the labelled
    documents (keyed by content hash): only the gated texts missing from it
    are translated; the result equals the uncached flow."""
    from ..operators.gate import content_key
    from .flows import bigram_fluency, nb_scorer, pivot_with_metrics
    w, prior = nb_model(spark, sf)
    seed = labelled_docs(spark, sf).select(content_key("text").alias("key"),
                                           F.translate("text", _ASCII_LOWER, _ASCII_UPPER).alias("value"))
    _rows, m, _fresh = pivot_with_metrics(_with_labels(spark, sf), "doc_id", "text",
                                          nb_scorer(w, prior, "doc_id"), ascii_upper_model,
                                          drop_marked_words_model, ascii_lower_model, THRESHOLD, label="toxic",
                                          forward_cache=seed, fluency=bigram_fluency(bigram_model(spark, sf), "doc_id"))
    return m.select(*[r6(F.col(c)).alias(c) for c in ("sta", "sim", "fl", "clf_acc")], "n_rows")


@register("e3_finalize_best_of_n",
          f"""WITH best AS ({_o6_sql()})
 SELECT CAST(b.doc_id AS VARCHAR) AS ID, d.text AS tat_toxic,
   CASE WHEN c IS NULL OR regexp_matches(c, '^\\s*$') THEN d.text ELSE c END AS tat_detox1
 FROM (SELECT doc_id, {_c8_expr('best')} AS c FROM best) b JOIN documents d USING (doc_id)""")
def e3_finalize_best_of_n(spark, sf):
    """Candidates (3 per document) -> best of N in one
    aggregation -> rule ladder -> repaired rewrite table."""
    from .flows import finalize_best_of_n
    d = docs(spark, sf)
    long = d.select("doc_id", "text", F.posexplode(_attempts()).alias("attempt", "gen"))
    table, _report = finalize_best_of_n(long, "doc_id", "attempt", "gen", "text", TERMS, REPLACEMENTS,
                                        RULES, FALLBACK_RULES, PROMPT)
    return table


@register("e4_grid_search_flow",
          f"{_M9_SQL} SELECT grid_order, layer, alpha FROM cands ORDER BY sta + 0.5 * sim DESC, grid_order LIMIT 2")
def e4_grid_search_flow(spark, sf):
    from ..operators.vectors import parse_float_list, parse_int_range
    from .flows import grid_search_flow
    layers, alphas = parse_int_range("0-4"), parse_float_list(",".join(str(a) for a in ALPHAS))
    _c, top, _dev = grid_search_flow(emb(spark, sf), "layer", "embedding", "cls", layers, alphas, k=2)
    return top.select("grid_order", "layer", "alpha")


def _grid_cands_sql(e: str, grid: str, out: str) -> str:
    """Scores of the grid points of ``grid`` on the vectors of ``e``."""
    return f"""s_{out} AS (SELECT g.grid_order, g.layer, g.alpha, e.vec_id, e.pos, e.x, e.x - g.alpha * delta.d AS y, mn.m AS mneg, mp.m AS mpos
   FROM {grid} g JOIN {e} e ON e.layer = g.layer JOIN delta ON delta.layer = g.layer AND delta.pos = e.pos
   JOIN means mn ON mn.layer = g.layer AND mn.pos = e.pos AND mn.cls = 0 JOIN means mp ON mp.layer = g.layer AND mp.pos = e.pos AND mp.cls = 1),
 v_{out} AS (SELECT grid_order, layer, alpha, vec_id, sum(y * mneg) / nullif(sqrt(sum(y * y)) * sqrt(sum(mneg * mneg)), 0) AS cn,
   sum(y * mpos) / nullif(sqrt(sum(y * y)) * sqrt(sum(mpos * mpos)), 0) AS cp,
   coalesce(sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0), 0.0) AS cs FROM s_{out} GROUP BY ALL),
 {out} AS (SELECT grid_order, layer, alpha, avg(CASE WHEN coalesce(cn, 0.0) > coalesce(cp, 0.0) THEN 1.0 ELSE 0.0 END) AS sta,
   avg(cs) AS sim, count(*) AS n FROM v_{out} GROUP BY ALL)"""


_VH = "md5(concat('42:', vec_id::VARCHAR)), vec_id"


@register("e4_sampled_dev",
          f"""WITH {_GRID_SQL}, u AS ({_UNNEST}), base AS (SELECT DISTINCT vec_id, layer, cls FROM u),
 tr AS (SELECT vec_id FROM (SELECT *, row_number() OVER (PARTITION BY layer, cls ORDER BY {_VH}) AS rn FROM base) WHERE rn <= 15),
 va AS (SELECT vec_id FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY {_VH}) AS rn FROM base
   WHERE vec_id NOT IN (SELECT vec_id FROM tr)) WHERE rn <= 25),
 means AS (SELECT layer, cls, pos, avg(x) AS m FROM u WHERE vec_id IN (SELECT vec_id FROM tr) GROUP BY layer, cls, pos), {_DELTA_SQL},
 ev AS (SELECT * FROM u WHERE vec_id IN (SELECT vec_id FROM va)), {_grid_cands_sql('ev', 'grid', 'cands')},
 won AS (SELECT grid_order, layer, alpha FROM cands ORDER BY sta + 0.5 * sim DESC, grid_order LIMIT 2), {_grid_cands_sql('u', 'won', 'dev')}
 SELECT grid_order, layer, alpha, round(sta, 6) AS sta, round(sim, 6) AS sim, n FROM dev""")
def e4_sampled_dev(spark, sf):
    """E4 in full: means of a seeded sample per layer and class, the grid on a
    disjoint validation slice, the two winners run again on the whole table."""
    from .flows import grid_search_flow
    e = emb(spark, sf)
    _c, _top, dev = grid_search_flow(e, "layer", "embedding", "cls", list(range(5)), ALPHAS, k=2, key="vec_id",
                                     sample_sizes={0: 15, 1: 15}, n_val=25, seed=SEED, dev=e)
    return dev.select("grid_order", "layer", "alpha", r6(F.col("sta")).alias("sta"), r6(F.col("sim")).alias("sim"), "n")


@register("s1_raw_tsv_round_trip", f"SELECT CAST(doc_id AS VARCHAR) AS ID, {_C15_SQL} AS tat_toxic FROM documents")
def s1_raw_tsv_round_trip(spark, sf):
    """K1 in raw form + S1: single-line texts written as raw TSV (quotes
    stay data) and read back with the raw reader and its column check."""
    from ..sources import io as IO
    path = _scratch(spark, "raw")
    d = docs(spark, sf).select(F.col("doc_id").cast("string").alias("ID"), T.single_line("text").alias("tat_toxic"))
    IO.write_raw_tsv(d, path)
    return IO.read_tsv(spark, path, required=["ID", "tat_toxic"])


@register("s3_read_labelled",
          f"SELECT doc_id, text, toxic AS label FROM {_LABELLED} WHERE lang = 'en'")
def s3_read_labelled(spark, sf):
    """S3 + P4: resolve the text and label columns by candidates and keep
    one language."""
    from ..sources import io as IO
    lab = labelled_docs(spark, sf).select("doc_id", "lang", "text", "toxic", "quality")
    return IO.read_labelled(lab, ("sentence", "text"), ("label", "toxic"), lang="en").select("doc_id", "text", "label")


@register("s3_split_key", f"SELECT doc_id, text, toxic AS label, lang FROM {_LABELLED} WHERE lang = 'en'")
def s3_split_key(spark, sf):
    """S3 + P4 with a folder per language: the other folders are not read."""
    from ..sources import io as IO
    root = _scratch(spark, "split")
    labelled_docs(spark, sf).select("doc_id", F.col("text").alias("sentence"), "toxic", "lang").write.partitionBy("lang").parquet(root)
    return IO.read_split_corpus(spark, root, "lang", lang="en").select("doc_id", "text", "label", "lang")


@register("s4_line_cache_round_trip",
          f"SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS pos, {_C15_SQL} AS value FROM documents")
def s4_line_cache_round_trip(spark, sf):
    """K4 (line form) + S4: single-line texts written one per line in
    key order (range-sorted parts), read back with explicit positions."""
    from ..sources import io as IO
    path = _scratch(spark, "lines")
    docs(spark, sf).orderBy("doc_id").select(T.single_line("text").alias("value")).write.text(path)
    return IO.read_line_cache(spark, path, key="pos").select("pos", "value")


@register("s7_load_or_build",
          f"WITH {_MEANS_SQL}, {_DELTA_SQL} SELECT layer, pos::INTEGER AS pos, round(d::FLOAT::DOUBLE, 6) AS delta "
          "FROM delta")
def s7_load_or_build(spark, sf):
    """The diff-in-means bundle is built (it is not stored yet), saved,
    and read back; a second call only reads it."""
    from ..operators.vectors import class_means, diff_in_means
    from ..sources import io as IO
    path = _scratch(spark, "bundle-lob")

    def build():
        d = diff_in_means(class_means(emb(spark, sf), "embedding", ["layer", "cls"]), "cls", ["layer"])
        return d.select(F.col("delta").cast("array<float>").alias("vector"),
                        F.struct(F.lit("embeddings").alias("model_id"), F.col("layer").alias("layer_idx"),
                                 F.col("n_pos").cast("int").alias("n_toxic"),
                                 F.col("n_neg").cast("int").alias("n_nontoxic"),
                                 F.lit(64).alias("max_length")).alias("meta"))
    IO.load_or_build(spark, path, build, default_layer=-1)
    back = IO.load_or_build(spark, path, lambda: None, default_layer=-1)
    return back.select("layer", F.posexplode("vector").alias("pos0", "v")) \
        .select("layer", (F.col("pos0") + 1).alias("pos"), r6(F.col("v").cast("double")).alias("delta"))


_E2_ROWS_SQL = (_E2_SQL[:_E2_SQL.index(" ba AS (SELECT doc_id")].rstrip().rstrip(",")
                + """
 SELECT gen2.doc_id, gen2.generated, gen2.edited, round(gen2.p_before, 6) AS tox_score_before,
   round(sa.p, 6) AS tox_score_after FROM gen2 JOIN scoreda sa USING (doc_id)""")


@register("k2_results_csv_round_trip", _E2_ROWS_SQL)
def k2_results_csv_round_trip(spark, sf):
    """K2: the per-row evaluation table of the pivot flow written as CSV
    (multi-line, quoted texts) and read back with its schema."""
    from ..sources import io as IO
    from .flows import nb_scorer, pivot_with_metrics
    w, prior = nb_model(spark, sf)
    rows, _m, _ = pivot_with_metrics(docs(spark, sf).select("doc_id", "text"), "doc_id", "text",
                                     nb_scorer(w, prior, "doc_id"), ascii_upper_model, drop_marked_words_model,
                                     ascii_lower_model, THRESHOLD, similarity=None)
    path = _scratch(spark, "eval")
    IO.write_results(rows, path)
    back = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .schema(rows.schema).csv(path))
    return back.select("doc_id", "generated", "edited", r6(F.col("tox_score_before")).alias("tox_score_before"),
                       r6(F.col("tox_score_after")).alias("tox_score_after"))
