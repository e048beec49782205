"""Quality rules with risk-controlled thresholds.

Method: five rules give each document a statistic that is higher for worse
texts. A document is rejected by a rule if its statistic exceeds the cutoff of
its stratum (its language). Cutoffs are chosen on labelled documents so that
the share of good documents a rule rejects is at most ``ALPHA`` / rules, and so
at most ``ALPHA`` over all rules, in every stratum, all at once with confidence
1 - ``DELTA``:

* for each rule the cutoffs of a fixed grid are tested from the mildest on;
* a cutoff passes if the exact binomial tail P(X <= k | n, ALPHA / rules), with
  k of the stratum's n good labelled documents rejected, is at most
  DELTA / (rules x strata) (Bonferroni over rules and strata);
* testing stops at the first cutoff that fails (fixed sequence, so the grid
  itself needs no correction); the strictest passed cutoff holds.

A stratum with too few labelled documents passes nothing and is not filtered
by the method. The grid is data-free, so all labels serve as holdout.

Everything is DataFrame expressions: one pass computes the statistics inside
each row, one aggregation counts n and k for all cutoffs (a few numbers per
stratum), and the cutoffs (one row per stratum) join back.

Edge cases: null and empty texts have no words and fail the base rules; a
null language is a stratum of its own; an id counts as one trial: labels that
repeat an id count once, and not at all if they differ or have no quality, and
of rows that share a doc_id the worst values count (in the least of their
strata); such rows are judged each by itself; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Share of good documents that all rules together may reject, and the
#: probability that any of the guarantees fails.
ALPHA, DELTA = 0.05, 0.05
#: rule -> cutoffs, mildest first.
GRID = {
    "symbols": (4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "dup_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02),
    "repeats": (0.29, 0.25, 0.2, 0.17, 0.14, 0.11, 0.08, 0.05, 0.03, 0.01),
    "upper": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
    "word_length": (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.0),
}
_SPACES = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, counts and the rules' statistics of every document."""
    d = docs.select(F.col(key).alias("doc_id"), F.col(stratum).alias("stratum"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("bare", _without(F.col("t"), _SPACES))
    d = d.withColumn("words", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: _without(x, _SPACES) != ""))
    d = d.select("doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.char_length("bare").cast("long").alias("word_chars"),
                 (F.char_length("t") - F.char_length(_without(F.col("t"), _SYMBOLS))).cast("long").alias("n_symbols"),
                 F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.char_length(F.regexp_replace("bare", r"[^\p{Lu}]+", "")).alias("n_upper"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    # the 8-word windows as hashes of their word hashes
    windows = F.when(F.size("h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("h") - WINDOW + 1), lambda i: F.xxhash64(F.slice("h", i, WINDOW))))
    d = d.withColumn("w", F.coalesce(windows, F.array().cast("array<bigint>"))).drop("h")
    d = d.withColumn("repeated", F.size(F.array_distinct("w")) < F.size("w"))
    # starts of windows found twice: neighbours in hash order
    order = F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.col("repeated"), order)).drop("w")
    twice = F.filter("s", lambda e, j: ((j > 0) & (F.try_element_at("s", F.when(j > 0, j).otherwise(F.lit(1)))["x"] == e["x"]))
                     | F.coalesce(F.try_element_at("s", j + 2)["x"] == e["x"], F.lit(False)))
    starts = F.array_sort(F.transform(twice, lambda e: e["i"]))
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("p", begin, lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    d = d.withColumn("p", F.when(F.col("repeated"), starts)).drop("s")
    d = d.withColumn("n_repeat_words", F.when(F.col("repeated"), covered).otherwise(0).cast("long")).drop("p", "repeated")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return d.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
                    per("n_symbols", "n_words").alias("symbols"), per("n_dup_lines", "n_lines").alias("dup_lines"),
                    per("n_repeat_words", "n_words").alias("repeats"), per("n_upper", "word_chars").alias("upper"), per("word_chars", "n_words").alias("word_length"))


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(X <= k) of a binomial(n, p), exact terms summed in logarithms."""
    odds = math.log(p / (1 - p))
    term0 = n * F.lit(math.log(1 - p))
    state = F.struct(term0.alias("t"), term0.alias("sum"))

    def step(a, j):
        t = a["t"] + F.log((n - j + 1) / j) + odds
        hi, lo = F.greatest(t, a["sum"]), F.least(t, a["sum"])
        return F.struct(t.alias("t"), (hi + F.log1p(F.exp(lo - hi))).alias("sum"))

    return F.when(k <= 0, term0).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), state, step, lambda a: a["sum"]))


def cutoffs(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: the cutoff of each rule (null: the rule may not
    reject there), n (good labelled documents) and the counts it rests on."""
    # an id is one trial, however often it is labelled or stands in the table: of its rows the worst values count
    good = labels.groupBy(F.col(key).alias("doc_id")).agg(F.min(label).alias("least"), F.max(label).alias("most")).where("least = 1 and most = 1").select("doc_id")
    rows = (stats.where("not base_failed").join(good, "doc_id").groupBy("doc_id")
            .agg(F.min(F.struct("stratum")).alias("s"), *[F.max(r).alias(r) for r in GRID]).select(F.col("s.stratum").alias("stratum"), *GRID))
    counts = rows.groupBy("stratum").agg(F.count("*").alias("n"), *[
        F.array(*[F.count_if(F.col(r) > c) for c in cs]).alias(f"k_{r}") for r, cs in GRID.items()])
    strata = stored(counts, "risk-counts").df
    share = alpha / len(GRID)
    # one number: the strata that are tested
    level = F.log(F.lit(delta / len(GRID)) / F.greatest(F.lit(1), F.count("*").over(_whole())))
    d = strata.withColumn("level", level)
    for r, cs in GRID.items():
        fits = F.transform(f"k_{r}", lambda k: F.when(k < F.col("n") * share, log_binomial_tail(F.col("n"), k, share) <= F.col("level")).otherwise(False))
        # cutoffs passed before the first failure
        passed = F.aggregate(fits, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                             lambda a, f: F.struct((a["n"] + F.when(a["on"] & f, 1).otherwise(0)).alias("n"), (a["on"] & f).alias("on")), lambda a: a["n"])
        d = d.withColumn(f"passed_{r}", passed)
        d = d.withColumn(f"cut_{r}", F.when(F.col(f"passed_{r}") > 0, F.try_element_at(F.array(*map(F.lit, cs)), F.col(f"passed_{r}"))))
    return d.select("stratum", "n", *[f"cut_{r}" for r in GRID], *[f"k_{r}" for r in GRID])


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()  # over one row per stratum


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality",
          alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, counts, base_failed, kept of every document."""
    stats = stored(statistics(docs, key, text, stratum), "risk-stats").df
    cuts = stored(cutoffs(stats, labels, key, label, alpha, delta).select(F.col("stratum").alias("_s"), *[f"cut_{r}" for r in GRID]), "risk-cutoffs").small()
    d = stats.join(cuts, F.col("stratum").eqNullSafe(F.col("_s")), "left")
    rejected = F.lit(False)
    for r in GRID:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def _sql() -> str:
    share, rules = ALPHA / len(GRID), len(GRID)
    counts = ",\n  ".join(f"{r} AS ({' UNION ALL '.join(f'SELECT stratum, {i} AS g, {c} AS c, count(*) AS n, count(*) FILTER ({r} > {c}) AS k FROM good GROUP BY stratum' for i, c in enumerate(cs))})"
                          for r, cs in ((f"t_{r}", cs) for r, cs in GRID.items())).replace("FILTER (t_", "FILTER (")
    tail = (f"list_sum(list_transform(range(k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({share!r}) + (n - j) * ln(1 - {share!r}))))")
    ok = f"(k < n * {share!r} AND {tail} <= {DELTA!r} / {rules} / greatest(1, (SELECT count(DISTINCT coalesce(stratum, chr(1))) FROM good)))"
    passed = ",\n  ".join(f"p_{r} AS (SELECT stratum, arg_max(c, g) AS cut FROM (SELECT *, bool_and({ok}) OVER (PARTITION BY stratum ORDER BY g) AS fine FROM t_{r}) WHERE fine GROUP BY stratum)" for r in GRID)
    joins = " ".join(f"LEFT JOIN p_{r} ON p_{r}.stratum IS NOT DISTINCT FROM st.stratum" for r in GRID)
    rejected = " OR ".join(f"coalesce(st.{r} > p_{r}.cut, false)" for r in GRID)
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
win AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, sum(least({WINDOW}, i - coalesce(p, i - {WINDOW}))) AS n FROM (SELECT *, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM twice) GROUP BY rid),
c AS (SELECT d.rid, doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, length(regexp_replace(array_to_string(words, ''), '[^\\p{{Lu}}]+', '', 'g')) AS n_upper
      FROM d LEFT JOIN cov ON d.rid = cov.rid),
st AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_lines,
        CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeats, CASE WHEN word_chars > 0 THEN n_upper / word_chars ELSE 0 END AS upper,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length FROM c),
good AS (SELECT st.doc_id, CASE WHEN bool_or(stratum IS NULL) THEN NULL ELSE min(stratum) END AS stratum, {', '.join(f'max({r}) AS {r}' for r in GRID)} FROM st
         JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1) l ON l.doc_id = st.doc_id WHERE NOT base_failed GROUP BY st.doc_id),
  {counts},
  {passed}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept
FROM st {joins}"""


SQL = _sql()
