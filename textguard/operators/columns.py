"""Column-set helpers."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_columns(spec: str | Sequence[str]) -> list[str]:
    """'a, b,c' -> ['a', 'b', 'c']."""
    if isinstance(spec, str):
        return [c.strip() for c in spec.split(",") if c.strip()]
    return list(spec)


def apply_to_columns(df: DataFrame, columns: str | Sequence[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply a column function to each listed column in one projection;
    unknown columns are reported with a warning and skipped."""
    cols = parse_columns(columns)
    have = set(df.columns)
    missing = [c for c in cols if c not in have]
    if missing:
        warnings.warn(f"columns not found, skipped: {missing}", stacklevel=2)
    todo = {c: fn(F.col(c)) for c in cols if c in have}
    return df.withColumns(todo) if todo else df


def select_ordered(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, bool]:
    """Keep exactly ``columns`` in that order; also say whether the
    input had them in a different order."""
    present = [c for c in df.columns if c in set(columns)]
    return df.select(*columns), present != list(columns)
