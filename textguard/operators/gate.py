"""Gated editing, merging and result caches.

The rewrite flow is keyed, never positional: every stage carries the row key,
and merges are joins on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import fallback
from ..functions.text import _c
from ..session import materialize, ship_package

BatchFn = Callable[[list], list]


def _model_column(factory: Callable[[], BatchFn], batch_size: int, out_type: T.DataType, what: str, skip_null: bool):
    """A list-in / list-out model as a column function: Arrow carries the one
    text column, the other columns stay in the JVM. The model is built once
    per task, when the first text arrives."""
    from pyspark.sql.functions import pandas_udf

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = None
        for texts in batches:
            given = texts.astype(object).where(texts.notna(), None)
            at = [i for i, x in enumerate(given) if x is not None] if skip_null else list(range(len(given)))
            out = [None] * len(given)
            if at and fn is None:
                fn = factory()
            for lo in range(0, len(at), batch_size):
                rows = at[lo:lo + batch_size]
                got = list(fn([given.iloc[i] for i in rows]))
                if len(got) != len(rows):
                    raise ValueError(f"{what} returned {len(got)} items for {len(rows)}")
                for i, x in zip(rows, got, strict=True):
                    out[i] = x
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # a model's answer is not computed twice or moved past a filter
    return pandas_udf(run, out_type).asNondeterministic()


def gated_edit(df: DataFrame, gate, text: str, out_col: str,
               editor: Callable[[Column], Column] | None = None,
               batch_editor: Callable[[], BatchFn] | None = None,
               batch_size: int = 16) -> DataFrame:
    """G1: ``out_col`` = editor(text) where ``gate`` holds, else ``text``.

    ``editor`` is a column function (runs JVM-side; CASE evaluates it only
    for gated rows). ``batch_editor`` is a factory returning a list-in /
    list-out Python function (a model): it is built once per task that has a
    gated row and sees only the gated texts of each Arrow batch, ``batch_size``
    at a time; the output must have one item per input. Only those texts go
    through Python (null for the other rows); a gated null has no text to edit
    and stays null. No shuffle.
    """
    g = _c(gate) if not isinstance(gate, str) else F.col(gate)
    if editor is not None:
        return df.withColumn(out_col, F.when(g, editor(F.col(text))).otherwise(F.col(text)))
    if batch_editor is None:
        raise ValueError("give editor or batch_editor")
    ship_package(df.sparkSession)
    model = _model_column(batch_editor, batch_size, T.StringType(), "editor", skip_null=True)
    gated = df.withColumn("_gate", F.coalesce(g, F.lit(False))).withColumn("_edit", model(F.when(F.col("_gate"), F.col(text))))
    return gated.withColumn(out_col, F.when(F.col("_gate"), F.col("_edit")).otherwise(F.col(text))).drop("_gate", "_edit")


def batch_map(df: DataFrame, factory: Callable[[], BatchFn], in_col: str, out_col: str,
              batch_size: int = 16, out_type: T.DataType | None = None) -> DataFrame:
    """M2: apply a list-in/list-out model to every row; the model is built
    once per task, row count and order per batch are checked. Only ``in_col``
    goes through Python."""
    ship_package(df.sparkSession)
    model = _model_column(factory, batch_size, out_type or T.StringType(), "model", skip_null=False)
    return df.withColumn(out_col, model(F.col(in_col)))


def first_available(factories: Sequence[Callable[[], BatchFn]]) -> Callable[[], BatchFn]:
    """M3: a factory that returns the first backend that loads (resolved on
    the executor, where the model runs)."""
    def make():
        errors = []
        for f in factories:
            try:
                return f()
            except Exception as e:  # noqa: BLE001 - try the next backend
                errors.append(repr(e))
        raise RuntimeError("no backend available: " + "; ".join(errors))
    return make


def pivot_edit(df: DataFrame, gate, text: str, out_col: str,
               forward: Callable[[], BatchFn] | None, edit: Callable[[], BatchFn] | None,
               back: Callable[[], BatchFn] | None, batch_size: int = 16) -> DataFrame:
    """M4: on gated rows, translate forward, edit, translate back (each stage
    optional); other rows keep ``text``. One Python hop for all stages."""
    stages = [s for s in (forward, edit, back) if s is not None]

    def factory():
        fns = [s() for s in stages]

        def run(xs):
            for f in fns:
                xs = list(f(xs))
            return xs
        return run
    return gated_edit(df, gate, text, out_col, batch_editor=factory, batch_size=batch_size)


def round_trip(df: DataFrame, text: str, forward: Callable[[], BatchFn], back: Callable[[], BatchFn],
               out_col: str = "roundtrip", batch_size: int = 16) -> DataFrame:
    """M5: text -> forward -> back, for every row (ungated)."""
    def factory():
        f, b = forward(), back()
        return lambda xs: list(b(list(f(xs))))
    return batch_map(df, factory, text, out_col, batch_size)


def merge_edits(df: DataFrame, edits: DataFrame, key: str, text: str, edit_col: str,
                out_col: str) -> DataFrame:
    """Left join of externally produced edits by key; rows without an
    edit keep ``text``."""
    e = edits.select(key, F.col(edit_col).alias("_e"))
    return df.join(e, key, "left").withColumn(out_col, F.coalesce("_e", text)).drop("_e")


def repair(df: DataFrame, id_col: str, source: str, rewrite: str,
           columns: Sequence[str] | None = None) -> DataFrame:
    """Id as string, required columns in order, blank rewrites filled
    from the source. Returns a new table (inputs are never overwritten)."""
    cols = list(columns or [id_col, source, rewrite])
    out = df
    if rewrite not in out.columns:
        out = out.withColumn(rewrite, F.lit(None).cast("string"))
    out = out.withColumn(id_col, F.col(id_col).cast("string")) \
        .withColumn(rewrite, fallback(F.col(rewrite), F.col(source)))
    return out.select(*cols)


def content_key(c) -> Column:
    """Cache key of a text: sha256 hex (same function in DuckDB)."""
    return F.sha2(_c(c), 256)


def with_cache(df: DataFrame, cache: DataFrame | None, text: str, out_col: str,
               compute: Callable[[DataFrame], DataFrame], save_to: str | None = None,
               stage: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Reuse cached results by content hash, compute only the misses.

    The distinct keys of the input meet the cache in one left join, stored as
    the lookup table (keys and values, no texts). Keys without a value are
    computed once per distinct text (``compute`` maps a frame with ``text`` to
    one with an added ``value`` column) and stored too, so a model behind it
    runs once, however often the results are read. The input then meets the
    lookup in a single left join (unique on its side; a hot key of the input
    is split by AQE). ``cache(key, value)`` may hold duplicates; the smallest
    value counts. With ``save_to`` the new entries are appended there (K4,
    under ``stage``). Returns ``(result, new_cache_entries)``.
    """
    keyed = df.withColumn("_k", content_key(text))
    known = keyed.select("_k").distinct()
    if cache is None:
        known = known.withColumn("_v", F.lit(None).cast("string"))
    else:
        one = cache.groupBy(F.col("key").alias("_k")).agg(F.min(F.struct(F.col("value").cast("string").alias("v"))).alias("_s"))
        known = known.join(one, "_k", "left").select("_k", F.col("_s.v").alias("_v"))
    known = materialize(known, "cache-known")
    missing = known.where(F.col("_v").isNull() & F.col("_k").isNotNull()).select("_k")
    misses = keyed.select("_k", text).join(missing, "_k", "left_semi").dropDuplicates(["_k"])
    fresh = materialize(compute(misses).select(F.col("_k").alias("key"), F.col("value").cast("string").alias("value")), "cache-fresh")
    if save_to:
        from ..sources.io import write_cache
        write_cache(fresh, save_to, stage=stage)
    lookup = known.where(F.col("_v").isNotNull()).unionByName(fresh.select(F.col("key").alias("_k"), F.col("value").alias("_v")))
    result = keyed.join(lookup, "_k", "left").withColumnRenamed("_v", out_col).drop("_k")
    return result, fresh
