"""End-to-end flows composed from the
operators. They return DataFrames; what several branches read is stored once,
nothing is collected.

* :func:`clean_gate_edit` - clean, score, gate, edit gated rows, fall back.
* :func:`pivot_with_metrics` - score, gate, translate/edit/translate back on
  gated rows (with a content-hash cache), rescore, metrics.
* :func:`finalize_best_of_n` - pick the best candidate per key, rule-clean,
  repair into the rewrite table, report.
* :func:`grid_search_flow` - class means per layer, grid over (layer, alpha),
  top-k.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import gate as G
from ..operators import metrics as M
from ..operators import scoring as SC
from ..operators import select as SEL
from ..operators import vectors as V

Scorer = Callable[[DataFrame, str, str], DataFrame]  # (df, text column, out column) -> df + score


def nb_scorer(weights: DataFrame, prior: float, key: str) -> Scorer:
    """Adapter: a trained naive Bayes model as a scorer."""
    return lambda df, text, out: SC.score_naive_bayes(df, weights, prior, key, text, out)


def bigram_fluency(model, key: str) -> Scorer:
    """Adapter: a trained bigram model as a per-text perplexity."""
    def add(df: DataFrame, text: str, out: str) -> DataFrame:
        ppl = SC.text_perplexity(SC.bigram_nll(df, model, key, text), key)
        return df.join(SC.per_text(ppl.withColumnRenamed("ppl", out), "perplexities"), key, "left")
    return add


def clean_gate_edit(df: DataFrame, key: str, text: str, terms: Sequence[str], patterns: Sequence[str],
                    scorer: Scorer, threshold: float = P.DEFAULT_THRESHOLD,
                    editor: Callable[[Column], Column] | None = None,
                    batch_editor: Callable[[], G.BatchFn] | None = None,
                    batch_size: int = 16, out_col: str = "rewrite") -> DataFrame:
    """C4 clean -> score the cleaned text -> P1 gate -> G1 edit gated
    rows (column editor or Python batch editor) -> G2 fallback to the
    original text where the result is blank. Adds ``cleaned``, ``p`` and
    ``edited``."""
    from ..session import materialize
    # read by the scorer's token branch and by its join back: cleaned once
    d = materialize(df.withColumn("cleaned", T.cleanse(text, terms, patterns)), "cleaned")
    d = scorer(d, "cleaned", "p")
    d = d.withColumn("edited", F.coalesce(P.gate("p", threshold), F.lit(False)))
    g = G.gated_edit(d, F.col("edited"), "cleaned", "_edit", editor=editor,
                     batch_editor=batch_editor, batch_size=batch_size)
    return g.withColumn(out_col, P.fallback(F.col("_edit"), F.col(text))).drop("_edit")


def pivot_with_metrics(df: DataFrame, key: str, text: str, scorer: Scorer,
                       forward: Callable[[], G.BatchFn] | None, edit: Callable[[], G.BatchFn] | None,
                       back: Callable[[], G.BatchFn] | None, threshold: float = P.DEFAULT_THRESHOLD,
                       similarity: Callable[[Column, Column], Column] | None = SC.text_similarity,
                       label: str | None = None, batch_size: int = 16,
                       forward_cache: DataFrame | None = None,
                       fluency: Callable[[DataFrame, str, str], DataFrame] | None = None
                       ) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Score the raw text, gate, run forward -> edit -> back on gated
    rows only, fall back to the source, rescore; return the per-row
    evaluation table (text, generated, edited, tox_score_before,
    tox_score_after[, cos, ppl, label]), the one-row metrics (sta, sim, fl,
    clf_acc) and the new forward-cache entries.

    The caller's models run once: the edited rows are stored before anything
    reads them, so the score belongs to the text that is returned. ``fluency``
    (df, text column, out column) adds a per-text perplexity.

    Without ``forward_cache`` all stages run in one Arrow hop per task. With
    it (``key, value`` by content hash), gated texts are looked up, only the
    misses are translated (once per distinct text), then edit and back run on
    the gated rows, which are merged back by ``key``."""
    d = scorer(df, text, "tox_score_before")
    d = d.withColumn("edited", F.coalesce(P.gate("tox_score_before", threshold), F.lit(False)))
    fresh = None
    if forward_cache is None or forward is None:
        d = G.pivot_edit(d, F.col("edited"), text, "_gen", forward, edit, back, batch_size)
    else:
        from ..session import materialize
        # the scored input feeds two branches (gated subset, join back):
        # store it once instead of scoring twice
        d = materialize(d, "pivot-scored")
        gated = d.where(F.col("edited")).select(key, text)
        fwd, fresh = G.with_cache(gated, forward_cache, text, "_fwd",
                                  lambda m: G.batch_map(m, forward, text, "value", batch_size))
        rest = [s for s in (edit, back) if s is not None]

        def chain():
            fns = [s() for s in rest]

            def run(xs):
                for f in fns:
                    xs = list(f(xs))
                return xs
            return run
        edited = G.batch_map(fwd, chain, "_fwd", "_gen", batch_size) if rest else fwd.withColumnRenamed("_fwd", "_gen")
        # rows that are not gated meet no edit: their texts stay where they are
        rest = d.where(~F.col("edited")).withColumn("_gen", F.lit(None).cast("string"))
        d = d.where(F.col("edited")).join(edited.select(key, "_gen"), key, "left").unionByName(rest)
    from ..session import materialize
    # most texts come back as they went in: those are stored once
    kept = F.when(~F.col("generated").eqNullSafe(F.col(text)), F.col("generated"))
    changed = F.coalesce(~F.col("generated").eqNullSafe(F.col(text)), F.lit(False))
    d = materialize(d.withColumn("generated", P.fallback(F.col("_gen"), F.col(text))).drop("_gen")
                    .withColumn("_changed", changed).withColumn("generated", kept), "pivot-generated")
    d = d.withColumn("generated", F.when(F.col("_changed"), F.col("generated")).otherwise(F.col(text))).drop("_changed")
    if similarity is not None:
        d = d.withColumn("cos", similarity(F.col(text), F.col("generated")))
    if fluency is not None:
        d = fluency(d, "generated", "ppl")
    d = scorer(d, "generated", "tox_score_after")
    cols = [key, text, "generated", "edited", "tox_score_before", "tox_score_after"]
    cols += (["cos"] if similarity is not None else []) + (["ppl"] if fluency is not None else []) + ([label] if label else [])
    per_row = d.select(*cols)  # the metrics read its numbers alone
    metrics = M.evaluate(per_row, p_after="tox_score_after", cos="cos" if similarity is not None else None,
                         fluency="ppl" if fluency is not None else None, p_before="tox_score_before" if label else None, label=label,
                         threshold=threshold)
    return per_row, metrics, fresh


def finalize_best_of_n(cands: DataFrame, key: str, attempt: str, gen: str, source: str,
                       terms: Sequence[str], replacements: Sequence[tuple[str, str]] = (),
                       rules: Sequence[tuple[str, str]] = (), fallback_rules: Sequence[tuple[str, str]] = (),
                       prompt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Best of N per key (one aggregation over the long candidate
    table) -> rule ladder (C8) -> repair into ``ID, tat_toxic, tat_detox1``
    (G3) -> report (A11). Keys are carried, never renumbered."""
    best = SEL.best_of_n_grouped(cands, key, attempt, gen, source, terms, replacements, prompt)
    if rules:
        best = best.withColumn("best", T.rule_clean("best", rules, fallback_rules))
    table = G.repair(best.select(F.col(key).alias("ID"), F.col(source).alias("tat_toxic"),
                                 F.col("best").alias("tat_detox1")), "ID", "tat_toxic", "tat_detox1")
    return table, M.table_report(table, "tat_toxic", "tat_detox1")


def grid_search_flow(vectors: DataFrame, layer: str, vec: str, cls: str, layers: Sequence[int],
                     alphas: Sequence[float], k: int = 2, key: str | None = None,
                     sample_sizes: dict | None = None, n_val: int | None = None, seed: int = 42,
                     dev: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Per-layer class means (one aggregation), the (layer, alpha)
    grid scored in one job, top k, and the winners re-run on ``dev``.

    With ``sample_sizes`` ({class: n}) the means come from a seeded
    per-class sample (O1) of each layer and, with ``n_val``, the grid is
    scored on a validation slice of that layer that is disjoint from the
    sample (O3). Returns ``(candidates, top_k, dev_scores)``."""
    from ..operators import sampling as SA
    from ..session import materialize
    spark = vectors.sparkSession
    v = vectors.where(F.col(layer).isin(list(layers)))
    train, val = v, v
    if sample_sizes:
        if key is None:
            raise ValueError("sampling needs a key column")
        train = SA.sample_per_class(v, [layer, cls], {(l, c): n for l in layers for c, n in sample_sizes.items()}, key, seed)
        if n_val:
            rest = v.join(train.select(key), key, "left_anti")
            val = SA.sample_per_class(rest, layer, {l: n_val for l in layers}, key, seed)
    means = materialize(V.class_means(train, vec, [layer, cls]), "class-means")
    cands, top = V.grid_search(val, means, V.param_grid(spark, layers, alphas), layer, vec, cls, k)
    dev_scores = None
    if dev is not None:
        winners = top.select("grid_order", layer, "alpha")
        dev_scores, _ = V.grid_search(dev.where(F.col(layer).isin(list(layers))), means, winners,
                                      layer, vec, cls, k)
    return cands, top, dev_scores
