"""Predicates and per-row scores (P1-P7, G2, J6) as column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .terms import count_hits
from .text import _c, _let, is_blank, split_ws, strip_ws

__all__ = ["gate", "is_blank", "fallback", "term_hits", "is_valid_rewrite",
           "word_overlap", "missing_columns", "require_columns"]

# Fixed value: default gate threshold (inclusive).
DEFAULT_THRESHOLD = 0.5


def gate(p, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """``p >= threshold`` (inclusive)."""
    return _c(p) >= F.lit(float(threshold))


def fallback(new, src) -> Column:
    """The source where the result is blank."""
    return F.when(is_blank(new), _c(src)).otherwise(_c(new))


def term_hits(c, terms: Sequence[str]) -> Column:
    """Number of list entries contained in the lower-cased text
    (duplicate entries count twice, an empty entry is always contained). The
    text is lower-cased once and searched once per layer of the list, at every
    lexicon size."""
    return _let(F.lower(_c(c)), lambda low: count_hits(low, list(terms)))


def is_valid_rewrite(new, src, terms: Sequence[str], min_chars: int = 3,
                     min_ratio: float = 0.3, max_ratio: float = 3.0) -> Column:
    """P5: at least ``min_chars`` after strip, length ratio to the source in
    [min_ratio, max_ratio] (ratio 1.0 for an empty source), no lexicon term."""
    n, s = _c(new), _c(src)
    ratio = F.when(F.length(s) > 0, F.length(n) / F.length(s)).otherwise(F.lit(1.0))
    ok = (n.isNotNull() & (F.length(strip_ws(n)) >= min_chars)
          & (ratio >= min_ratio) & (ratio <= max_ratio) & (term_hits(n, terms) == 0))
    return F.coalesce(ok, F.lit(False))


def word_overlap(src, new) -> Column:
    """|set(lower src words) & set(lower new words)| / max(|src set|, 1)."""
    a = F.array_distinct(split_ws(F.lower(_c(src))))
    b = F.array_distinct(split_ws(F.lower(_c(new))))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required columns absent from ``df`` (in the given order)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    miss = missing_columns(df, required)
    if miss:
        raise ValueError(f"missing required columns: {miss}")
    return df
