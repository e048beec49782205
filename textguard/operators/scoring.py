"""Scorers trained and applied as Spark jobs (M1 toxicity, M6 similarity,
M7 fluency).

They stand in for the neural models of a rewrite flow: the gate, merge and
metric semantics around them are what matters, and each one is a plain
aggregation/join plan that scales with the corpus.

Scale notes
-----------
* Training is ``explode -> groupBy(word[, class])``: partial aggregation
  combines hot words map-side, so a word holding a third of all tokens costs
  one row per task before the shuffle.
* Scoring packs texts into blocks (``operators/blocks.py``): a block's distinct
  words or word runs meet the model once, and the sums of its texts are taken
  in the block, so neither a row per word nor a text is shuffled for a score.
* Per-text similarity (M6) needs no shuffle at all: both count vectors live
  in the same row and are compared with sorted-array functions.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _at, _c, _let
from ..session import broadcast_if_small, materialize, shuffles_deleted, stored_bytes, with_size
from . import blocks as B

# Fixed value: token class used on the driver's tables (lower-cased ASCII words).
DEFAULT_TOKEN_PATTERN = "[a-z]+"
# Fixed value: logit clamp for the sigmoid.
LOGIT_CLAMP = 30.0


def tokens(c, pattern: str = DEFAULT_TOKEN_PATTERN) -> Column:
    """Lower-cased tokens matching ``pattern`` (``[\\p{L}\\p{N}_]+`` in general)."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(pattern), 0)


def token_counts(c, pattern: str = DEFAULT_TOKEN_PATTERN) -> Column:
    """Per-row bag of words as ``array<struct<w string, n long>>`` sorted by
    word; computed inside the row (sort + run lengths), no shuffle."""
    return _run_lengths(tokens(c, pattern))


def _run_ends(s: Column) -> Column:
    """Places (from 1) at which a run of equal values of a sorted array ends; none for null."""
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))), lambda i: ~F.get(s, i - 1).eqNullSafe(F.get(s, i)))


def _run_lengths(values: Column) -> Column:
    """Distinct values of an array with their counts, sorted."""
    def rle(s):
        return _let(_run_ends(s), lambda ends: F.transform(ends, lambda e, j: F.struct(
            F.get(s, e - 1).alias("w"), (e - F.coalesce(F.get(ends, j - 1), F.lit(0))).cast("long").alias("n"))))
    return _let(F.sort_array(values), rle)


def _squares(s: Column) -> Column:
    """Sum of the squared counts of the distinct values of a sorted array."""
    def total(ends):
        return F.aggregate(F.transform(ends, lambda e, j: (e - F.coalesce(F.get(ends, j - 1), F.lit(0))).cast("double")),
                           F.lit(0.0), lambda acc, n: acc + n * n)
    return _let(_run_ends(s), total)


def cosine_counts(a: Column, b: Column) -> Column:
    """Cosine of two sorted bags from :func:`token_counts`; 0 when either is empty."""
    def dot(m):
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(m), F.lit(2))), F.lit(0.0),
                           lambda acc, i: acc + F.when(
                               (i <= F.size(m)) & (_at(m, i)["w"] == _at(m, i - 1)["w"]),
                               _at(m, i)["n"] * _at(m, i - 1)["n"]).otherwise(F.lit(0)))

    def norm(v):
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x["n"] * x["n"]))

    def go(x, y):
        d = _let(F.array_sort(F.concat(x, y)), dot)
        return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(d / (norm(x) * norm(y)))
    return _let(a, lambda x: _let(b, lambda y: go(x, y)))


def text_similarity(a, b, pattern: str = DEFAULT_TOKEN_PATTERN) -> Column:
    """M6: cosine of the token-count vectors of two texts (0 if one is empty).

    With the words of both texts in one bag, ``|a + b|^2 = |a|^2 + |b|^2 + 2ab``:
    sums of squared counts are all it takes, and one of them where the texts
    have the same words."""
    def cosine(x, y):
        def go(q):  # |x|^2, |y|^2, whole numbers
            both = (_let(F.sort_array(F.concat(x, y)), _squares) - q["x"] - q["y"]) / 2
            return F.when(x == y, q["x"]).otherwise(both) / (F.sqrt(q["x"]) * F.sqrt(q["y"]))
        words = F.coalesce((F.size(x) > 0) & (F.size(y) > 0), F.lit(False))
        squares = _let(_squares(x), lambda qx: F.struct(qx.alias("x"), F.when(x == y, qx).otherwise(_squares(y)).alias("y")))
        return F.when(words, _let(squares, go)).otherwise(F.lit(0.0))
    return _let(F.sort_array(tokens(a, pattern)), lambda x: _let(F.sort_array(tokens(b, pattern)), lambda y: cosine(x, y)))


# --------------------------------------------------------------------------
# M1: multinomial naive Bayes toxicity score
# --------------------------------------------------------------------------

def train_naive_bayes(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic",
                      pattern: str = DEFAULT_TOKEN_PATTERN, store: bool = True) -> tuple[DataFrame, float]:
    """Return ``(weights, prior)``.

    ``weights(word, weight)``: ``ln((c1+1)/(n1+v)) - ln((c0+1)/(n0+v))`` with
    c1/c0 the word's token counts in positive/negative texts, n1/n0 their
    sums and v the vocabulary size. ``prior``: the log odds of the positive
    share of texts. The totals are one-row aggregates read as literals.
    """
    lab = labelled.select(F.col(text_col).alias("_t"), F.col(label_col).cast("int").alias("_y")) \
        .where(F.col("_y").isNotNull())
    if pattern == DEFAULT_TOKEN_PATTERN:
        counts = B.class_counts(lab.select(F.lower("_t").alias("_t"), "_y"))
    else:
        counts = (lab.select("_y", F.explode(tokens("_t", pattern)).alias("word"))
                  .select("word", (F.col("_y") == 1).cast("long").alias("c1"), (F.col("_y") == 0).cast("long").alias("c0")))
    counts = counts.groupBy("word").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    if store:
        # the model is a table: written once (shared checkpoint folder), then
        # every scorer reads it and knows its size
        counts = materialize(counts, "nb-counts")
    tot = counts.agg(F.sum("c1").alias("n1"), F.sum("c0").alias("n0"), F.count("*").alias("v")).first()
    n1, n0, v = (tot["n1"] or 0), (tot["n0"] or 0), tot["v"]
    weights = counts.select(
        "word",
        (F.log((F.col("c1") + 1) / F.lit(float(n1 + v))) - F.log((F.col("c0") + 1) / F.lit(float(n0 + v))))
        .alias("weight"))
    weights = with_size(weights, stored_bytes(counts))
    cls = lab.agg(F.sum(F.when(F.col("_y") == 1, 1).otherwise(0)).alias("p"),
                  F.sum(F.when(F.col("_y") == 0, 1).otherwise(0)).alias("q")).first()
    prior = math.log(cls["p"] / cls["q"]) if cls["p"] and cls["q"] else (math.inf if cls["p"] else -math.inf)
    return weights, prior


def score_naive_bayes(df: DataFrame, weights: DataFrame, prior: float, key: str,
                      text_col: str = "text", out_col: str = "p_toxic",
                      pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """M1: add ``out_col`` = sigmoid(prior + sum of token weights), logit
    clamped to +-30; unknown words weigh 0 and every input row is kept."""
    return score_naive_bayes_many(df, weights, prior, key, {out_col: text_col}, pattern)


def score_naive_bayes_many(df: DataFrame, weights: DataFrame, prior: float, key: str,
                           outputs: dict[str, str], pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """M1 for several text columns at once (``{out_col: text_col}``): the words
    of all of them in one set of blocks, one aggregation per key with a
    conditional sum per column, one join back."""
    names = list(outputs)
    sums = _nb_parts(df, weights, key, list(outputs.values()), pattern, by_text=True).groupBy("_nb_key").agg(*_nb_sums(len(names)))
    out = df.join(per_text(sums.withColumnRenamed("_nb_key", key), "scores"), key, "left")
    for i, o in enumerate(names):
        out = out.withColumn(o, _nb_probability(prior, F.col(f"_nb_s{i}")))
    return out.drop(*[f"_nb_s{i}" for i in range(len(names))])


def per_text(numbers: DataFrame, name: str) -> DataFrame:
    """A few numbers per key, stored: while they are small they go to the texts,
    which are then not shuffled."""
    return broadcast_if_small(materialize(numbers, name))


def _nb_sums(n: int) -> list[Column]:
    return [F.sum(F.when(F.col("_nb_c").bitwiseAND(1 << i) != 0, F.col("_nb_x"))).alias(f"_nb_s{i}") for i in range(n)]


def _nb_probability(prior: float, total: Column) -> Column:
    logit = F.lit(float(prior)) + F.coalesce(total, F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-LOGIT_CLAMP), F.least(F.lit(LOGIT_CLAMP), logit))))


def _nb_parts(df: DataFrame, weights: DataFrame, key: str, texts: list[str], pattern: str, blocks: DataFrame | None = None,
              by_text: bool = False) -> DataFrame:
    """(_nb_key, _nb_c, _nb_x): what each known word of a text adds to its
    logit, or with ``by_text`` all of them; the bits of ``_nb_c`` tell the text columns. A text with the words of
    the first one, in their order, sends none of its own. The weights meet the
    distinct words of a block of texts, not the words of each text."""
    blocks = _blocks(df, key, texts, pattern) if blocks is None else blocks
    parts = B.weighted_words(blocks, broadcast_if_small(weights), "weight", len(texts), by_text)
    return parts.select(F.col("k").alias("_nb_key"), F.col("c").alias("_nb_c"), F.col("x").alias("_nb_x"))


def _blocks(df: DataFrame, key: str | Column, texts: list[str], pattern: str) -> DataFrame:
    # words of letters are split in the blocks' own task, not one by one in the JVM
    split = (lambda t: F.lower(_c(t))) if pattern == DEFAULT_TOKEN_PATTERN else (lambda t: tokens(t, pattern))
    return B.text_blocks(df.select(_c(key).alias("_k"), *[split(t).alias(f"_t{i}") for i, t in enumerate(texts)]))


def _text_bytes(df: DataFrame, text_col: str) -> int:
    return df.agg(F.sum(F.octet_length(text_col).cast("long")).alias("n")).first()["n"] or 0


def _run_counts(reference: DataFrame, text_col: str, pattern: str, runs: B.Runs, store: bool) -> B.RunCounts:
    return B.RunCounts(reference.select(tokens(text_col, pattern).alias("t")), runs, _text_bytes(reference, text_col), store)


# --------------------------------------------------------------------------
# M7: add-one bigram language model, A6 / A7 perplexity
# --------------------------------------------------------------------------

def train_bigrams(reference: DataFrame, text_col: str = "text",
                  pattern: str = DEFAULT_TOKEN_PATTERN, store: bool = False) -> B.RunCounts:
    """Counts of the reference texts' bigrams and of the words that open one,
    with the number of distinct words. They are counted where they are looked
    up; with ``store`` they are kept as a table, for models that score often."""
    return _run_counts(reference, text_col, pattern, B.pairs, store)


def bigram_nll(df: DataFrame, model: B.RunCounts, key: str,
               text_col: str = "text", pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """Per text: ``(key, nll_sum, n_pred, n_tokens)``: negative log
    likelihood of tokens 2..n under the add-one model
    ``P(b|a) = (c(a,b)+1)/(c(a)+v)``.

    A block of texts asks once for each of its distinct bigrams, and gets
    their counts back (``blocks.RunCounts``); texts without a bigram keep their row."""
    return _stored_nll(_nll_parts(df, model, key, text_col, pattern), key)


def _stored_nll(parts: DataFrame, key: str) -> DataFrame:
    """The sums of each text, stored: whoever reads them runs no model again."""
    return materialize(parts.groupBy("_bg_key").agg(*_nll_sums()).withColumnRenamed("_bg_key", key), "nll")


def _nll_sums() -> list[Column]:
    return [F.coalesce(F.sum("_bg_nll"), F.lit(0.0)).alias("nll_sum"),
            F.coalesce(F.sum("_bg_n"), F.lit(0)).cast("long").alias("n_pred"),
            F.max("_bg_len").alias("n_tokens")]


def _nll_parts(df: DataFrame, model: B.RunCounts, key: str, text_col: str, pattern: str, blocks: DataFrame | None = None, i: int = 0,
               cost=B.pair_cost) -> DataFrame:
    """(_bg_key, _bg_len, _bg_nll, _bg_n): words, cost and predictions of each text."""
    blocks = _blocks(df, key, [text_col], pattern) if blocks is None else blocks
    return model.sums(blocks, i, cost).select(F.col("k").alias("_bg_key"), F.col("size").alias("_bg_len"), F.col("nll").alias("_bg_nll"), F.col("n").alias("_bg_n"))


def text_perplexity(nll: DataFrame, key: str, min_tokens: int = 3) -> DataFrame:
    """``exp(mean nll)`` per text; null for texts with fewer than
    ``min_tokens`` tokens."""
    return nll.select(key, _ppl(min_tokens).alias("ppl"))


def _ppl(min_tokens: int = 3) -> Column:
    return F.when(F.col("n_tokens") >= min_tokens, F.exp(F.col("nll_sum") / F.col("n_pred")))


def corpus_perplexity(nll: DataFrame) -> DataFrame:
    """``exp(sum nll / sum predicted tokens)``; +inf at zero tokens."""
    s, n = F.sum("nll_sum"), F.sum("n_pred")
    return nll.agg(F.when(n > 0, F.exp(s / n)).otherwise(F.lit(float("inf"))).alias("corpus_ppl"),
                   n.alias("n_pred"))


def evaluation_rows(df: DataFrame, key: str, source: str, rewrite: str, nb: tuple[DataFrame, float], bigrams: B.RunCounts,
                    labels: DataFrame, label: str, pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """What M8 is computed from: (key, cos, p_before, p_after, ppl, label) per
    row of ``df`` (unique ``key``).

    Words, bigrams, similarities and labels are partial results of one key:
    they go into one union and are summed by key at once. No text, and no score,
    is joined back."""
    weights, prior = nb
    columns = {"_in": "int", "cos": "double", "_nb_c": "int", "_nb_x": "double", "_bg_len": "long", "_bg_nll": "double", "_bg_n": "long", "_label": "int"}

    def part(frame: DataFrame, k: str, **given) -> DataFrame:
        return frame.select(F.col(k).alias("_k"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    both = _blocks(df, key, [source, rewrite], pattern)
    rows = part(B.cosines(both), "k", _in=F.lit(1), cos=F.col("cos"))
    rows = rows.unionAll(part(_nb_parts(df, weights, key, [source, rewrite], pattern, both, True), "_nb_key", _nb_c=F.col("_nb_c"), _nb_x=F.col("_nb_x")))
    costs = _nll_parts(df, bigrams, key, rewrite, pattern, both, 1)
    rows = rows.unionAll(part(costs, "_bg_key", _bg_len=F.col("_bg_len"), _bg_nll=F.col("_bg_nll"), _bg_n=F.col("_bg_n")))
    rows = rows.unionAll(part(labels, key, _label=F.col(label)))
    got = rows.groupBy("_k").agg(F.max("_in").alias("_in"), F.max("cos").alias("cos"), F.max("_label").alias(label), *_nb_sums(2), *_nll_sums()).where("_in = 1")
    rows = got.select(F.col("_k").alias(key), "cos", _nb_probability(prior, F.col("_nb_s0")).alias("p_before"), _nb_probability(prior, F.col("_nb_s1")).alias("p_after"),
                      _ppl().alias("ppl"), label)
    return materialize(rows, "evaluation")


# --------------------------------------------------------------------------
# M7 with both sides: pseudo-perplexity
# --------------------------------------------------------------------------

class TwoSided:
    """Counts of words between their neighbours.

    ``P(w | l, r) = (c(l,w,r) + q) / (c(l,r) + 1)`` backs off to
    ``q = ((c(l,w) + 1) / (c(l) + v) + (c(w,r) + 1) / (c(r) + v)) / 2``; v is the
    number of distinct words. The ends of a text are neighbours too. With ``store``
    the counts are kept as a table, for models that score often; without, a score
    counts the runs it asks for, some kinds of them at a time."""

    def __init__(self, reference: DataFrame, text_col: str = "text", pattern: str = DEFAULT_TOKEN_PATTERN, store: bool = False):
        self.reference, self.text_col, self.pattern, self.store = reference, text_col, pattern, store
        if store:
            _ = self.counts

    @cached_property
    def counts(self) -> B.RunCounts:
        return _run_counts(self.reference, self.text_col, self.pattern, B.centres, self.store)

    @property
    def words(self) -> int:
        return self.counts.words


def pseudo_nll(df: DataFrame, model: TwoSided, key: str, text_col: str = "text", pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """M7: per text ``(key, nll_sum, n_pred, n_tokens)`` with every token
    predicted from its two neighbours (A6 and A7 take it like
    :func:`bigram_nll`). A block of texts asks once for each distinct run. Where
    the model's texts are another column of ``df``, a run that a row has in both
    is named once (``blocks.sums_in_turns``)."""
    if model.store:
        return _stored_nll(_nll_parts(df, model.counts, key, text_col, pattern, cost=B.centre_cost), key)
    size = _text_bytes(model.reference, model.text_col)
    if df is model.reference and pattern == model.pattern:
        blocks, given, asked, corpus = _blocks(df, key, [model.text_col, text_col], pattern), 0, 1, None
    else:
        blocks, given, asked = _blocks(df, key, [text_col], pattern), None, 0
        corpus = _blocks(model.reference, F.lit(0), [model.text_col], model.pattern)
    sums = B.sums_in_turns(blocks, given, asked, corpus, B.centre_turns, size, B.centre_cost)
    parts = sums.select(F.col("k").alias("_bg_key"), F.col("size").alias("_bg_len"), F.col("nll").alias("_bg_nll"), F.col("n").alias("_bg_n"))
    with shuffles_deleted(df.sparkSession):
        return _stored_nll(parts, key)
