"""Lexicons of any size as column expressions.

A list of terms is compiled to a prefix tree written as one regular
expression, so a position of the text is compared with the few letters that can
follow and not with every term. Terms that begin with one another are put into
different *layers*: inside a layer at most one term stands at a position, and
a look-ahead finds the term of every position, overlapping ones too. A text is
scanned once per layer (the longest chain of terms that begin with each other,
usually two to four), however long the list is.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regex import IGNORE_CASE, escape_literal

#: Up to so many terms are faster looked for one by one.
SHORT_LIST = 16
#: Between the terms of a list that is written as one literal; not part of any term.
_BETWEEN = "\x00"


def tree_pattern(terms: Sequence[str]) -> str:
    """A regular expression that matches, at a position, the longest of
    ``terms`` that stands there. Many branches are halved by their letters."""
    tree: dict = {}
    for t in terms:
        node = tree
        for ch in t:
            node = node.setdefault(ch, {})
        node[""] = {}

    def halves(keys: list[str], out: list[str]) -> str:
        if len(out) <= 4:
            return "|".join(out)
        mid = len(out) // 2
        return f"(?=[{keys[0]}-{keys[mid - 1]}])(?:{halves(keys[:mid], out[:mid])})|{halves(keys[mid:], out[mid:])}"

    def write(node: dict) -> str:
        out = []
        for ch in sorted(k for k in node if k):
            text, below = escape_literal(ch), node[ch]
            while len(below) == 1 and "" not in below:  # a run without branches
                (step, below), = below.items()
                text += escape_literal(step)
            out.append(text + write(below))
        if not out:
            return ""
        if len(out) == 1 and "" not in node:
            return out[0]
        keys = sorted(k for k in node if k)
        # a class of small letters is the same with and without case
        plain = all(k.isascii() and (k.islower() or k.isdigit()) for k in keys)
        return "(?:" + (halves(keys, out) if plain else "|".join(out)) + ")" + ("?" if "" in node else "")

    # the recursion follows branches, never more of them than a term has letters
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 2 * max(map(len, terms), default=0) + 500))
    try:
        return write(tree)
    finally:
        sys.setrecursionlimit(limit)


def prefix_layers(terms: Sequence[str]) -> list[list[str]]:
    """The distinct ``terms`` (no empty ones) in layers in which none is
    another's beginning."""
    layers: list[list[str]] = []
    depth: dict[str, int] = {}
    for t in sorted(set(terms)):  # beginnings come first
        at = max((depth[t[:n]] for n in range(1, len(t)) if t[:n] in depth), default=-1) + 1
        depth[t] = at
        if at == len(layers):
            layers.append([])
        layers[at].append(t)
    return layers


def found_terms(c: Column, layers: Sequence[Sequence[str]], flags: str = "") -> list[Column]:
    """For each layer the distinct terms that stand in the text, as they are written there."""
    return [F.array_distinct(F.regexp_extract_all(c, F.lit(f"{flags}(?=({tree_pattern(x)}))"), F.lit(1))) for x in layers]


def count_hits(low: Column, terms: Sequence[str]) -> Column:
    """How many entries of ``terms`` stand in ``low`` (repeated entries count
    each time, an empty one always); 0 for null."""
    times = Counter(terms)
    n = F.lit(times.pop("", 0))
    if len(times) <= SHORT_LIST:
        for t, k in times.items():
            n = n + F.when(low.contains(t), k).otherwise(0)
        return F.when(low.isNull(), F.lit(0)).otherwise(n)
    again = sorted(t for t, k in times.items() if k > 1)
    more = F.split(F.lit(" ".join(["0", *(str(times[t] - 1) for t in again)])), " ").cast("array<int>")

    def hits(found: Column) -> Column:
        if not again:
            return F.size(found)
        return F.aggregate(found, F.lit(0), lambda sum_, w: sum_ + 1 + F.element_at(more, F.array_position(_constant(again), w).cast("int") + 1))

    for found in found_terms(low, prefix_layers(list(times))):
        n = n + hits(found)
    return F.when(low.isNull(), F.lit(0)).otherwise(n)


# --- ignoring case -----------------------------------------------------------------

def fold(text: str) -> str:
    """Letter by letter the form in which a case-insensitive match compares:
    the lower case of the upper case, where these are one letter."""
    out = []
    for ch in text:
        up = ch.upper()
        low = (up if len(up) == 1 else ch).lower()
        out.append(low[0])
    return "".join(out)


@cache
def _other_forms() -> tuple[str, str]:
    """Letters whose lower case is not their folded form, or depends on their place in a word."""
    odd = [ch for ch in map(chr, range(0x80, sys.maxunicode + 1)) if not 0xD800 <= ord(ch) < 0xE000 and (ch.lower() != fold(ch) or ch == "Σ")]
    return "".join(odd), "".join(fold(ch) for ch in odd)


def folded(c: Column) -> Column:
    """:func:`fold` of a column."""
    return F.lower(F.translate(c, *_other_forms()))


def _constant(values: Sequence[str]) -> Column:
    """An array of strings written as one literal, however many they are."""
    return F.split(F.lit(_BETWEEN.join(values)), _BETWEEN)


def delete_in_order(c: Column, terms: Sequence[str]) -> Column:
    """C1 for long lists: what deleting each term's occurrences (any case), one
    term after the other, leaves of the text.

    A term takes part only if it stands in the text when its turn comes. The
    terms found in the text are worked off in the order of the list; a deletion
    can join new occurrences, so the letters around the places where it has cut
    are searched again and what stands there, if its turn is still to come, is
    put in line. A term that another deletion has broken finds nothing to
    delete. The whole text is searched once (a pass per layer), and again only
    after a cut on both sides of a stretch shorter than a term.
    """
    from .text import _let
    terms = [t for t in terms if t]
    if any(_BETWEEN in t for t in terms):
        raise ValueError("a term holds U+0000")
    if not terms:
        return c
    keys = [fold(t) for t in terms]
    layers = prefix_layers(keys)
    key_of, pattern_of = _constant(keys), _constant([IGNORE_CASE + escape_literal(t) for t in terms])
    n, reach = len(terms), max(map(len, terms)) - 1

    def places(text: Column, after: Column) -> Column:
        """Places in the list, beyond ``after``, of the terms that stand in ``text``."""
        found = [F.transform(x, folded) for x in found_terms(text, layers, IGNORE_CASE)]
        found = found[0] if len(found) == 1 else F.concat(*found)
        return _let(F.slice(key_of, after + 1, n), lambda rest: F.transform(F.filter(
            F.transform(found, lambda w: F.array_position(rest, w)), lambda p: p > 0), lambda p: (p + after).cast("int")))

    def around(parts: Column, text: Column) -> Column:
        """The letters on both sides of each cut."""
        sides = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts)),
                           lambda a, b: F.concat(F.right(a, F.lit(reach)), F.left(b, F.lit(reach))))
        short = F.exists(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda x: F.char_length(x) < reach)
        return F.when(short, text).otherwise(F.array_join(sides, _BETWEEN))

    def step(state: Column, _i: Column) -> Column:
        at = F.element_at(state["todo"], 1)

        def cut(parts):
            return _let(F.array_join(parts, ""), lambda text: F.struct(text.alias("text"), F.array_sort(F.array_distinct(F.concat(
                F.slice(state["todo"], 2, n), places(around(parts, text), at)))).alias("todo")))
        return F.when(F.size(state["todo"]) == 0, state).otherwise(_let(F.split(state["text"], F.element_at(pattern_of, at), -1), cut))

    # each step leaves a place of the list behind
    steps = F.sequence(F.lit(1), F.lit(n))
    begin = F.struct(c.alias("text"), F.array_sort(F.array_distinct(places(c, F.lit(0)))).alias("todo"))
    done = F.aggregate(steps, begin, step, lambda state: state["text"])
    return F.when(c.rlike(IGNORE_CASE + tree_pattern(layers[0])), done).otherwise(c)
