"""Selection: top-k, head, best-of-N candidate choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_valid_rewrite, term_hits
from ..functions.text import (
    _c, _let, clean_generated, collapse_ws, drop_toxic_tokens, filter_tokens, split_ws, strip_ws,
)
from ..session import materialize


def top_k(df: DataFrame, score: str, k: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """The k rows with the highest ``score``; ties keep ``tie_break``
    order. Planned as TakeOrderedAndProject (per-task top k + one merge)."""
    return df.orderBy(F.col(score).desc(), *[F.col(c).asc() for c in tie_break]).limit(k)


def limit_head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first n rows in an explicit order (scan order is not an order)."""
    return df.orderBy(*order_by).limit(n)


# --------------------------------------------------------------------------
# O6 best of N
# --------------------------------------------------------------------------

def _len3(x: Column, n: int = 3) -> Column:
    return x.isNotNull() & (F.length(strip_ws(x)) >= n)


def prepare_attempt(raw, source, terms: Sequence[str], replacements: Sequence[tuple[str, str]] = (),
                    prompt: str | None = None, source_words: Column | None = None) -> Column:
    """One attempt of O6 as ``struct(gen, ok, valid, score)``: C14, then C9
    when it leaves at least 3 chars; score = 10 * term hits - 5 * word
    overlap with the source (lower is better). ``source_words`` (distinct
    lower-cased source words) can be passed in when it is shared by several
    attempts of the same row."""
    src = _c(source)
    sw = source_words if source_words is not None else F.array_distinct(split_ws(F.lower(src)))

    def build(g):
        return _let(term_hits(g, terms), lambda hits: _build(g, hits))

    def _build(g, hits):
        gw = F.array_distinct(split_ws(F.lower(g)))
        overlap = F.size(F.array_intersect(sw, gw)) / F.greatest(F.size(sw), F.lit(1))
        ratio = F.when(F.length(src) > 0, F.length(g) / F.length(src)).otherwise(F.lit(1.0))
        ok = _len3(g)
        valid = F.coalesce(ok & (ratio >= 0.3) & (ratio <= 3.0) & (hits == 0), F.lit(False))
        return F.struct(g.alias("gen"), ok.alias("ok"), valid.alias("valid"),
                        (10.0 * hits - 5.0 * overlap).alias("score"))

    def pick_filtered(g):
        return _let(filter_tokens(g, terms, replacements),
                    lambda f: F.when(_len3(f), f).otherwise(g))

    return _let(_let(clean_generated(raw, src, prompt), pick_filtered), build)


def best_of_n(attempts, source, terms: Sequence[str], replacements: Sequence[tuple[str, str]] = (),
              prompt: str | None = None) -> Column:
    """O6 on an ``array<string>`` of generations (attempt order), per row.

    Fold: the first attempt with >= 3 chars becomes the best; a later one
    replaces it only if valid and strictly lower in score; stop once an
    attempt is valid and the best score is <= 0. If the winner is not a
    valid rewrite: C9 of the source, then the aggressive C9b. Finally C3 and
    C9; the source when fewer than 3 chars remain.
    """
    src = _c(source)
    init = F.struct(F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("bs"),
                    F.lit(False).alias("done"))

    # what comes after the stop is not looked at
    def step(acc, raw, sw):
        return F.when(acc["done"], acc).otherwise(_let(prepare_attempt(raw, src, terms, replacements, prompt, sw), lambda a: fold(acc, a)))

    def fold(acc, a):
        take = (~acc["done"]) & a["ok"] & (acc["best"].isNull() | (a["valid"] & (a["score"] < acc["bs"])))
        best = F.when(take, a["gen"]).otherwise(acc["best"])
        bs = F.when(take, a["score"]).otherwise(acc["bs"])
        done = acc["done"] | (a["valid"] & (bs <= 0))
        return F.struct(best.alias("best"), bs.alias("bs"), done.alias("done"))

    winner = _let(F.array_distinct(split_ws(F.lower(src))), lambda sw: F.aggregate(_c(attempts), init, lambda acc, raw: step(acc, raw, sw))["best"])
    return finish_best(winner, src, terms, replacements)


def finish_best(winner, src, terms, replacements) -> Column:
    def rescue(w):
        bad = ~_len3(w) | ~is_valid_rewrite(w, src, terms)
        soft = filter_tokens(src, terms, replacements)
        return F.when(bad, _let(soft, lambda s: F.when(_len3(s), s).otherwise(drop_toxic_tokens(src, terms))))\
            .otherwise(w)

    def final(b):
        f = filter_tokens(collapse_ws(b), terms, replacements)
        return F.when(b.isNull() | (b == ""), b).otherwise(f)

    out = _let(_let(_c(winner), rescue), final)
    return _let(out, lambda o: F.when(_len3(o), o).otherwise(src))


def best_of_n_grouped(cands: DataFrame, key: str, attempt: str, gen: str, source: str,
                      terms: Sequence[str], replacements: Sequence[tuple[str, str]] = (),
                      prompt: str | None = None) -> DataFrame:
    """O6 on a long table ``(key, attempt, gen, source)`` without collecting a
    key's attempts; ``(key, attempt)`` is unique.

    The sequential fold has a closed form. Let F be the first attempt with
    >= 3 chars (score s_F), V the first valid attempt, N the first valid
    attempt with score <= 0 and M the valid attempt with the lowest (score,
    attempt). Then the winner is:

    * s_F <= 0: F if V is F or there is no V; else V when s_V < s_F, else F
      (the fold stops at V);
    * s_F > 0: N if it exists (the fold stops there and nothing before it
      scores <= 0); else the lower of (s_F, F) and M.

    The prepared attempts are stored once. The aggregation sees attempt
    numbers and scores alone (``min`` over structs of numbers, partial sort
    aggregation without any text, so a hot key stays cheap); the winner's text
    is fetched by key.
    Where the attempts of a key are one array, :func:`best_of_n` needs no
    shuffle at all.
    """
    p = cands.select(key, attempt, source,
                     prepare_attempt(F.col(gen), F.col(source), terms, replacements, prompt).alias("a"))
    p = materialize(p.select(key, attempt, source, "a.*"), "attempts")
    by_attempt = F.struct(F.col(attempt).alias("t"), F.col("score").alias("s"))
    by_score = F.struct(F.col("score").alias("s"), F.col(attempt).alias("t"))
    agg = p.groupBy(key).agg(
        F.min(attempt).alias("_any"),
        F.min(F.when(F.col("ok"), by_attempt)).alias("f"),
        F.min(F.when(F.col("valid"), by_attempt)).alias("v"),
        F.min(F.when(F.col("valid") & (F.col("score") <= 0), by_attempt)).alias("n"),
        F.min(F.when(F.col("valid"), by_score)).alias("m"))
    f, v, n, m = F.col("f"), F.col("v"), F.col("n"), F.col("m")
    f_by_score = F.struct(f["s"].alias("s"), f["t"].alias("t"))
    win = (F.when(f["s"] <= 0,
                  F.when(v.isNull() | (v["t"] == f["t"]), f["t"])
                  .when(v["s"] < f["s"], v["t"]).otherwise(f["t"]))
           .when(n.isNotNull(), n["t"])
           .otherwise(F.least(f_by_score, F.coalesce(m, f_by_score))["t"]))
    # the row that carries the source, and the winner's text if there is a winner
    best = agg.select(F.col(key).alias("_k"), F.coalesce(win, "_any").alias("_t"), f.isNotNull().alias("_won"))
    row = p.join(best, F.col(key).eqNullSafe(F.col("_k")) & (F.col(attempt) == F.col("_t")))
    return row.select(key, source, finish_best(F.when(F.col("_won"), F.col("gen")), F.col(source), terms, replacements).alias("best"))
