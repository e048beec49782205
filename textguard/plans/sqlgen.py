"""SQL fragments for the DuckDB oracle statements (RE2 dialect).

They restate each operator independently in SQL so the Spark plan can be
checked against a second engine; they are not used by the Spark side.
"""

from __future__ import annotations

from collections.abc import Sequence

# Fixed value: punctuation stripped from token ends (same as TOKEN_PUNCT).
PUNCT_SQL = ".,!?;:()[]{}\"''"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(xs: Sequence[str]) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]" if xs else "[]::VARCHAR[]"


def nested_replace(expr: str, pats: Sequence[str], repl: str = "", flags: str = "gi") -> str:
    for p in pats:
        expr = f"regexp_replace({expr}, {q(p)}, {q(repl)}, '{flags}')"
    return expr


def collapse(expr: str) -> str:
    return rf"trim(regexp_replace({expr}, '\s+', ' ', 'g'))"


def split_ws(expr: str) -> str:
    return rf"list_filter(string_split_regex({expr}, '\s+'), lambda lt_: lt_ <> '')"


def key(w: str) -> str:
    return f"trim(lower({w}), {q(PUNCT_SQL[:-1])})"


def term_hits(expr: str, terms: Sequence[str]) -> str:
    return f"CAST(len(list_filter({str_list(terms)}, lambda lt_: contains(lower({expr}), lt_))) AS INTEGER)"


def drop_toxic(expr: str, terms: Sequence[str], min_len: int = 4) -> str:
    long_terms = [t for t in terms if len(t) >= min_len]
    kept = (f"list_filter({split_ws(expr)}, lambda lw_: NOT list_contains({str_list(terms)}, {key('lw_')}) "
            f"AND len(list_filter({str_list(long_terms)}, lambda lu_: contains({key('lw_')}, lu_))) = 0)")
    return f"(CASE WHEN len({kept}) = 0 THEN {expr} ELSE array_to_string({kept}, ' ') END)"


def filter_tokens(expr: str, terms: Sequence[str], reps: Sequence[tuple[str, str]], min_len: int = 4) -> str:
    long_terms = [t for t in terms if len(t) >= min_len]
    rep_list = "[" + ", ".join(f"{{'k': {q(k)}, 'v': {q(v)}}}" for k, v in reps) + "]"
    per = (f"CASE WHEN list_contains({str_list(terms)}, {key('lw_')}) THEN NULL "
           f"WHEN len(list_filter({str_list(long_terms)}, lambda lu_: contains({key('lw_')}, lu_))) > 0 "
           f"THEN nullif(list_filter({rep_list}, lambda lr_: contains({key('lw_')}, lr_.k))[1].v, '') "
           f"ELSE lw_ END")
    joined = f"array_to_string(list_transform({split_ws(expr)}, lambda lw_: {per}), ' ')"
    return f"(CASE WHEN {expr} IS NULL OR {expr} = '' THEN {expr} ELSE {collapse(joined)} END)"


def normalize_punct(expr: str) -> str:
    x = f"regexp_replace({expr}, '!{{3,}}', '!!', 'g')"
    x = rf"regexp_replace({x}, '\?{{3,}}', '??', 'g')"
    x = rf"regexp_replace({x}, '\.{{3,}}', '...', 'g')"
    x = rf"regexp_replace({x}, '\s+([,.!?;:])', '\1', 'g')"
    return collapse(x)


def rules(expr: str, rs: Sequence[tuple[str, str]]) -> str:
    for p, r in rs:
        expr = f"regexp_replace({expr}, {q(p)}, {q(r)}, 'gi')"
    return expr


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"


def label_pattern(word: str) -> str:
    """RE2 stand-in for Python's ``\\bWORD\\b\\s*:?`` (ignore case); use with
    replacement ``\\1\\3``. RE2 has no lookarounds, so the boundary chars are
    captured and put back."""
    return rf"(^|[^\pL\pN_])(?i:{word})(?:(\s+:?|:)|($|[^\pL\pN_:\s]))"


def keep_two_repeats(words: str) -> str:
    """Words without the third and later of equal neighbours. Each word meets
    its two predecessors through shifted lists, built once per row."""
    lw = f"list_transform({words}, lambda lx_: lower(lx_))"
    z = f"list_zip({words}, {lw}, list_prepend(NULL::VARCHAR, {lw}), list_prepend(NULL::VARCHAR, list_prepend(NULL::VARCHAR, {lw})))"
    kept = f"list_filter({z}, lambda lz_: lz_[1] IS NOT NULL AND NOT coalesce(lz_[2] = lz_[3] AND lz_[3] = lz_[4], false))"
    return f"array_to_string(list_transform({kept}, lambda lz_: lz_[1]), ' ')"
