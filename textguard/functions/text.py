"""Text cleaning and repair as Spark column expressions.

Every function takes and returns a ``Column`` and runs JVM-side
(``regexp_replace`` and higher-order array functions), so the work stays in
the executors, is evaluated lazily, and composes into a single ``Project``.
Semantics follow Python's ``str``/``re`` behaviour on the same input.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import IGNORE_CASE, LINE_BREAK, UNICODE, WS, WS_CHARS, escape_literal, python_regex_to_java
from .terms import delete_in_order, tree_pattern


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it several times inside ``fn`` without
    copying its expression tree (nested copies grow the plan exponentially)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def _at(arr: Column, i) -> Column:
    """1-based array access, null when out of range (ANSI-safe)."""
    return F.try_element_at(arr, i if isinstance(i, Column) else F.lit(i))


def _arr(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


# --------------------------------------------------------------------------
# whitespace
# --------------------------------------------------------------------------

def is_blank(c) -> Column:
    """Null, empty or whitespace only."""
    col = _c(c)
    return col.isNull() | (F.ltrim(col, F.lit(WS_CHARS)) == "")


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace (incl. U+001C-1F) at both ends."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def rstrip_ws(c) -> Column:
    return F.rtrim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """Runs of whitespace become one space, then strip."""
    return F.trim(F.regexp_replace(_c(c), f"{UNICODE}{WS}+", " "))


def single_line(c) -> Column:
    """Line breaks become spaces, then C3."""
    return collapse_ws(F.regexp_replace(_c(c), "[\\r\\n]", " "))


def split_ws(c) -> Column:
    """Python ``str.split()``: whitespace tokens, no empty strings."""
    return F.filter(F.split(_c(c), f"{UNICODE}{WS}+"), lambda t: t != "")


def split_lines(c) -> Column:
    """Python ``str.splitlines()`` (no trailing empty element)."""
    def trim_last(parts):
        n = F.size(parts)
        return F.when(_at(parts, -1) == "", F.slice(parts, 1, F.greatest(n - 1, F.lit(0)))
                      ).otherwise(parts)
    return F.when(_c(c) == "", F.array().cast("array<string>")).otherwise(
        _let(F.split(_c(c), LINE_BREAK), trim_last))


# --------------------------------------------------------------------------
# ordered deletion
# --------------------------------------------------------------------------

def literal_pattern(term: str) -> str:
    return IGNORE_CASE + escape_literal(term)


#: Up to so many terms a chain of replacements is as fast as a search for the terms; the rows are the same.
CHAIN_TERMS = 16


def remove_literals(c, terms: Sequence[str]) -> Column:
    """Delete every case-insensitive occurrence of each term, in list
    order. Long lists are searched for in one pass (``terms.delete_in_order``),
    and only the terms that a text holds are deleted one by one."""
    if len(terms) > CHAIN_TERMS:
        return delete_in_order(_c(c), terms)
    return reduce(lambda acc, t: F.regexp_replace(acc, literal_pattern(t), ""),
                  [t for t in terms if t], _c(c))


def java_pattern(p: str, ignore_case: bool = True) -> str:
    return (IGNORE_CASE if ignore_case else UNICODE) + python_regex_to_java(p)


def remove_patterns(c, patterns: Sequence[str], ignore_case: bool = True) -> Column:
    """Delete the matches of each (Python-syntax) regex, in order."""
    return reduce(lambda acc, p: F.regexp_replace(acc, java_pattern(p, ignore_case), ""),
                  patterns, _c(c))


def cleanse(c, terms: Sequence[str], patterns: Sequence[str] = (), guard: bool = True) -> Column:
    """C4 = C1 -> C2 -> C3.

    With ``guard`` the chain is skipped for texts in which no term and no
    pattern occurs: the first change of the chain needs a match in the
    original text, so the guarded result is identical, and most texts pay
    for one scan instead of one per rule.
    """
    col = _c(c)
    literals, tree = remove_literals(col, terms), tree_pattern([t for t in terms if t])
    if guard and patterns and 1 < len(terms) <= CHAIN_TERMS and tree:
        # a text that only a pattern hits has no term to delete
        literals = F.when(col.rlike(IGNORE_CASE + tree), literals).otherwise(col)
    chain = remove_patterns(literals, patterns)
    if guard and (terms or patterns):
        alts = [x for x in [tree] if x] + ["(?:" + python_regex_to_java(p) + ")" for p in patterns]
        hit = col.rlike(IGNORE_CASE + "(?:" + "|".join(alts) + ")")
        chain = F.when(hit, chain).otherwise(col)
    return collapse_ws(chain)


# --------------------------------------------------------------------------
# rule groups, replacements, punctuation
# --------------------------------------------------------------------------

def apply_rules(c, rules: Sequence[tuple[str, str]], ignore_case: bool = True) -> Column:
    """Ordered (python regex, python replacement) substitutions."""
    from .regex import python_repl_to_java
    return reduce(
        lambda acc, r: F.regexp_replace(acc, java_pattern(r[0], ignore_case), python_repl_to_java(r[1])),
        rules, _c(c))


def normalize_punct(c) -> Column:
    """C7: '!!!+' -> '!!', '???+' -> '??', '...+' -> '...', no space before
    ,.!?;: and whitespace collapsed."""
    x = F.regexp_replace(_c(c), "!{3,}", "!!")
    x = F.regexp_replace(x, "\\?{3,}", "??")
    x = F.regexp_replace(x, "\\.{3,}", "...")
    x = F.regexp_replace(x, f"{UNICODE}{WS}+([,.!?;:])", "$1")
    return collapse_ws(x)


def rule_clean(c, rules: Sequence[tuple[str, str]], fallback_rules: Sequence[tuple[str, str]]) -> Column:
    """Full rule chain + C7; if fewer than 2 characters remain, redo on
    the source with only ``fallback_rules`` + C7 (kept as it is without such
    rules); if that is blank, the source. Always stripped; null becomes ''."""
    col = _c(c)
    full = normalize_punct(apply_rules(col, rules))
    # the chain is bound: its result is looked at, measured and returned
    if not fallback_rules:
        # nothing lighter to redo: the short result, or the source if it is blank
        return F.coalesce(strip_ws(_let(full, lambda r: F.when(is_blank(r), col).otherwise(r))), F.lit(""))
    light = normalize_punct(apply_rules(col, fallback_rules))

    def pick(r):
        short = (r == "") | (F.length(strip_ws(r)) < 2)
        return F.when(short, _let(light, lambda x: F.when(is_blank(x), col).otherwise(x))).otherwise(r)
    return F.coalesce(strip_ws(_let(full, pick)), F.lit(""))


# --------------------------------------------------------------------------
# token filters
# --------------------------------------------------------------------------

# Fixed value: characters stripped from both ends of a word before lookup.
TOKEN_PUNCT = ".,!?;:()[]{}\"'"


def _least(terms: Sequence[str]) -> list[str]:
    """The terms that contain no other one."""
    return [t for t in dict.fromkeys(terms) if not any(o != t and o in t for o in terms)]


def _may_hold(c: Column, terms: Sequence[str]) -> Column:
    """False only where no word of the text equals or contains a term."""
    if not terms or "" in terms:
        return F.lit("" in terms)
    if len(set(terms)) > CHAIN_TERMS:
        return F.lower(c).rlike(tree_pattern(terms))
    least = _least(terms)
    return _let(F.lower(c), lambda low: _any_in(low, least))


def _any_in(low: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(t) for t in terms])


def _token_key(w: Column) -> Column:
    return F.btrim(F.lower(w), F.lit(TOKEN_PUNCT))


def filter_tokens(c, terms: Sequence[str], replacements: Sequence[tuple[str, str]] = (),
                  min_contained_len: int = 4) -> Column:
    """Per whitespace token, key = lower-cased token stripped of
    punctuation. Exact lexicon term -> dropped. Else, if the key contains a
    term of at least ``min_contained_len`` chars -> the replacement of the
    first replacement key contained in it (dropped when empty or none).
    Else kept. Tokens joined by one space; null/'' returned unchanged."""
    col = _c(c)
    long_terms = [t for t in terms if len(t) >= min_contained_len]
    term_arr, long_arr = _arr(list(terms)), _arr(long_terms)
    rep = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in replacements]) \
        if replacements else F.array().cast("array<struct<k:string,v:string>>")

    short = 0 < len(set(terms)) <= CHAIN_TERMS and "" not in terms

    def per_word(w):
        found = _let(_token_key(w), lambda key: per_key(w, key))
        return F.when(_let(F.lower(w), lambda low: _any_in(low, _least(terms))), found).otherwise(w) if short else found

    def per_key(w, key):
        first_rep = _at(F.filter(rep, lambda r: key.contains(r["k"])), 1)["v"]
        return (F.when(F.array_contains(term_arr, key), F.lit(None))
                .when(F.exists(long_arr, lambda t: key.contains(t)), F.nullif(first_rep, F.lit("")))
                .otherwise(w))

    out = collapse_ws(F.array_join(F.transform(split_ws(col), per_word), " "))
    return F.when(col.isNull() | (col == ""), col).when(_may_hold(col, terms), out).otherwise(collapse_ws(col))


def drop_toxic_tokens(c, terms: Sequence[str], min_contained_len: int = 4) -> Column:
    """Aggressive variant: drop every token whose key is a term or
    contains a term of at least ``min_contained_len`` chars; the source when
    nothing is left."""
    col = _c(c)
    term_arr, long_arr = _arr(list(terms)), _arr([t for t in terms if len(t) >= min_contained_len])
    kept = F.filter(split_ws(col), lambda w: _let(
        _token_key(w), lambda k: ~F.array_contains(term_arr, k) & ~F.exists(long_arr, lambda t: k.contains(t))))
    out = _let(kept, lambda kp: F.when(F.size(kp) == 0, col).otherwise(F.array_join(kp, " ")))
    if "" in terms:
        return out
    return F.when(_may_hold(col, terms), out).otherwise(_let(collapse_ws(col), lambda x: F.when(x == "", col).otherwise(x)))


def drop_tokens_matching(c, char_class: str = "[A-Za-z]") -> Column:
    """Drop every whitespace token that holds a char of ``char_class``;
    join by a space; null -> ''."""
    col = F.coalesce(_c(c), F.lit(""))
    return F.array_join(F.filter(split_ws(col), lambda t: ~t.rlike(char_class)), " ")


def truncate_tokens(c, n: int) -> Column:
    """C17: keep the first ``n`` whitespace tokens."""
    return F.array_join(F.slice(split_ws(_c(c)), 1, n), " ")


def preview_text(c, n: int) -> Column:
    """C20: first ``n`` characters."""
    return F.substring(_c(c), 1, n)


# --------------------------------------------------------------------------
# output repair (C11-C14)
# --------------------------------------------------------------------------

def _word_bounded(word: str) -> str:
    from .regex import BOUNDARY
    return BOUNDARY + escape_literal(word) + BOUNDARY


# Prompt labels removed by C11 (ignore case), in this order.
ARTIFACT_LABELS = ("Текст", "Детокс", "Токсик")
ARTIFACT_PATTERNS = (
    _word_bounded("Текст") + f"{WS}*:?",
    _word_bounded("Детокс") + f"{WS}*:?",
    _word_bounded("Токсик") + f"{WS}*:?",
    f"\\{{{WS}*text{WS}*\\}}",
    _word_bounded("user") + f"{WS}*:?",
    _word_bounded("assistant") + f"{WS}*:?",
)


def strip_prompt_artifacts(c, patterns: Sequence[str] = ARTIFACT_PATTERNS,
                           leading_labels: Sequence[str] = ARTIFACT_LABELS) -> Column:
    """C11: delete label patterns (ignore case), C3, unwrap one pair of
    double or single quotes (then strip), delete a leading ``label:``."""
    x = reduce(lambda acc, p: F.regexp_replace(acc, IGNORE_CASE + p, ""), patterns,
               F.coalesce(_c(c), F.lit("")))
    x = collapse_ws(x)
    quoted = (x.startswith('"') & x.endswith('"')) | (x.startswith("'") & x.endswith("'"))
    x = F.when(quoted, strip_ws(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)
    lead = IGNORE_CASE + "(?m)^(?:" + "|".join(escape_literal(w) for w in leading_labels) + f"){WS}*:{WS}*"
    return strip_ws(F.regexp_replace(x, lead, ""))


def extract_marked_answer(c, marker: str = "Detoxed:", assistant_suffix: str = "assistant",
                          skip_prefix: str = "(", skip_word: str = "Translation") -> Column:
    """The answer after the last ``marker`` line.

    Strip and unwrap one pair of double quotes; take the non-blank stripped
    lines. If a line starts with ``marker``, take the first later line that
    is not a ``(...Translation...)`` note, else that marker line; without a
    marker line, the last line. Remove ``marker+assistant_suffix`` or
    ``marker`` at the start, then one trailing double quote."""
    long_m = marker + assistant_suffix

    def unquote(t):
        return F.when(t.startswith('"') & t.endswith('"'),
                      F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)

    def pick(lines):
        n = F.size(lines)
        marks = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                         lambda i: F.coalesce(_at(lines, i).startswith(marker), F.lit(False)))
        return _let(F.array_max(marks), lambda last: (
            F.when(n == 0, F.lit(""))
            .when(last.isNull(), _at(lines, -1))
            .otherwise(F.coalesce(
                _at(F.filter(F.slice(lines, last + 1, F.greatest(n, F.lit(1))),
                             lambda l: ~(l.startswith(skip_prefix) & l.contains(skip_word))), 1),
                _at(lines, last)))))

    def drop_prefix(cand, prefix, then):
        return F.when(cand.startswith(prefix), then(F.substring(cand, len(prefix) + 1, 1 << 30))).otherwise(cand)

    def tail(cand):
        return F.when(cand.endswith('"'), rstrip_ws(F.substring(cand, F.lit(1), F.length(cand) - 1))
                      ).otherwise(cand)

    lines = F.filter(F.transform(split_lines(_let(strip_ws(_c(c)), unquote)), strip_ws), lambda l: l != "")
    cand = _let(lines, pick)
    cand = _let(cand, lambda x: drop_prefix(x, long_m, strip_ws))
    cand = _let(cand, lambda x: drop_prefix(x, marker, strip_ws))
    cand = _let(cand, tail)
    return F.when(_c(c).isNull(), F.lit("")).otherwise(cand)


# Answer prefixes checked by C13 in this order (ignore case).
ANSWER_PREFIXES = ("assistant:", "assistant", "Assistant:", "Assistant", "Detoxed:",
                   "Detoxed", "Answer:", "Answer", "Җавап")


def extract_first_line(c, prefixes: Sequence[str] = ANSWER_PREFIXES) -> Column:
    """First line of the stripped text; remove the first matching
    prefix (ignore case) and any ':' after it; unwrap one pair of double
    quotes (length > 1). Null, empty or blank -> ''."""
    pref = F.array(*[F.struct(F.lit(p.lower()).alias("p"), F.lit(len(p)).alias("n")) for p in prefixes])
    t = strip_ws(F.coalesce(_c(c), F.lit("")))
    first = strip_ws(F.coalesce(_at(split_lines(t), 1), F.lit("")))

    def cut(x):
        hit = _at(F.filter(pref, lambda p: F.lower(x).startswith(p["p"])), 1)
        rest = strip_ws(F.regexp_replace(F.substring(x, hit["n"] + 1, 1 << 30), "^:+", ""))
        return F.when(hit.isNull(), x).otherwise(rest)

    def unquote(x):
        q = x.startswith('"') & x.endswith('"') & (F.length(x) > 1)
        return F.when(q, strip_ws(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)

    return _let(_let(first, cut), unquote)


def keep_two_repeats(c) -> Column:
    """At most two consecutive equal words (ignore case); words joined by a space."""
    def run(w):
        return _let(F.transform(w, F.lower), lambda lw: F.array_join(F.filter(
            w, lambda x, i: ~((i >= 2) & (_at(lw, i + 1) == _at(lw, i)) & (_at(lw, i) == _at(lw, i - 1)))),
            " "))

    def thrice(x):  # in its lower case, with single spaces
        return F.lower(x).rlike(r"(?:^| )([^ ]++) \1 \1(?: |\z)")
    return _let(collapse_ws(c), lambda x: F.when(thrice(x), run(F.split(x, " "))).otherwise(x))


def _strip_quotes(x: Column) -> Column:
    return strip_ws(F.btrim(F.btrim(x, F.lit('"')), F.lit("'")))


def clean_generated(c, source, prompt: str | None = None, min_chars: int = 3) -> Column:
    """C14: clean one generated answer.

    Drop an echoed ``prompt``; take distinct non-blank stripped lines (split
    on '\\n'); the first with at least ``min_chars`` chars after removing
    quotes, else the first line without quotes; the source when that is
    shorter than ``min_chars``; collapse whitespace; keep at most two
    consecutive equal words (ignore case)."""
    col, src = _c(c), _c(source)
    t = col
    if prompt:
        t = F.when(t.contains(prompt), strip_ws(F.replace(t, F.lit(prompt), F.lit("")))).otherwise(t)
    lines = F.array_distinct(F.filter(F.transform(F.split(t, "\n"), strip_ws), lambda l: l != ""))

    def choose(unq):
        good = _at(F.filter(unq, lambda l: F.length(l) >= min_chars), 1)
        return F.coalesce(good, _at(unq, 1))

    res = _let(F.transform(lines, _strip_quotes), choose)
    res = _let(res, lambda r: F.when(r.isNull() | (F.length(r) < min_chars), src).otherwise(r))
    res = keep_two_repeats(collapse_ws(res))
    return F.when(col.isNull() | (col == ""), src).otherwise(res)


# --------------------------------------------------------------------------
# prompts (C16)
# --------------------------------------------------------------------------

def build_prompt(c, template: str, slot: str = "{text}") -> Column:
    """Substitute the text into ``template`` at ``slot``; a template
    without the slot is an error (it would silently drop the text)."""
    if slot not in template:
        raise ValueError(f"template has no {slot} slot")
    parts = template.split(slot)
    pieces = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(_c(c))
        if p:
            pieces.append(F.lit(p))
    return F.concat(*pieces)


def build_messages(c, system: str | None, template: str = "{text}") -> Column:
    """Chat messages ``array<struct<role, content>>``."""
    user = F.struct(F.lit("user").alias("role"), build_prompt(c, template).alias("content"))
    if system is None:
        return F.array(user)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), user)
