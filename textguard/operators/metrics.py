"""Aggregate metrics (A1-A5, A10-A12, M8). Each is one ``agg`` (partial +
final aggregation, no data-size shuffle) and returns a small DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import DEFAULT_THRESHOLD
from ..functions.text import _c, is_blank


def sta(p_after, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """A1: share of rows with ``p_after < threshold`` (strict); NaN on no rows."""
    return F.coalesce(F.avg((_c(p_after) < threshold).cast("double")), F.lit(float("nan")))


def sim(cos) -> Column:
    """A2: mean of row similarities."""
    return F.avg(_c(cos))


def nanmean(c) -> Column:
    """A3/A10: mean ignoring null and NaN (NaN if nothing is left)."""
    x = _c(c)
    return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(float("nan")))


def accuracy(p, label, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """A4: share of rows where ``p >= threshold`` equals ``label == 1``."""
    pred = (_c(p) >= threshold).cast("int")
    return F.avg((pred == _c(label).cast("int")).cast("double"))


def confusion(df: DataFrame, p: str, label: str, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """A4 detail: tp, fp, tn, fn counts and accuracy in one row."""
    pred = F.col(p) >= threshold
    y = F.col(label) == 1
    cnt = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    return df.agg(cnt(pred & y).alias("tp"), cnt(pred & ~y).alias("fp"),
                  cnt(~pred & ~y).alias("tn"), cnt(~pred & y).alias("fn"),
                  accuracy(p, label, threshold).alias("accuracy"))


def evaluate(df: DataFrame, p_after: str | None = "p_after", cos: str | None = "cos",
             fluency: str | None = "fluency", p_before: str | None = None,
             label: str | None = None, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """M8: all metrics in one pass; a metric whose column is None is skipped
    (null in the output)."""
    nul = F.lit(None).cast("double")
    return df.agg(
        (sta(p_after, threshold) if p_after else nul).alias("sta"),
        (sim(cos) if cos else nul).alias("sim"),
        (nanmean(fluency) if fluency else nul).alias("fl"),
        (accuracy(p_before, label, threshold) if (p_before and label) else nul).alias("clf_acc"),
        F.count("*").alias("n_rows"))


def table_report(df: DataFrame, source: str, rewrite: str,
                 by: Sequence[str] = ()) -> DataFrame:
    """Rows, blank rewrites, blank sources, mean source and rewrite lengths."""
    aggs = [F.count("*").alias("n_rows"),
            F.sum(is_blank(rewrite).cast("long")).alias("n_blank_rewrite"),
            F.sum(is_blank(source).cast("long")).alias("n_blank_source"),
            F.avg(F.length(source)).alias("avg_len_source"),
            F.avg(F.length(rewrite)).alias("avg_len_rewrite")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def before_after_report(df: DataFrame, p_before: str, p_after: str, edited: str) -> DataFrame:
    """Per edited flag: rows, mean score before and after."""
    return df.groupBy(edited).agg(F.count("*").alias("n_rows"),
                                  F.avg(p_before).alias("avg_p_before"),
                                  F.avg(p_after).alias("avg_p_after"))
