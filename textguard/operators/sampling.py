"""Seeded sampling, splits and dense row ids.

Nothing here puts a whole table (or a whole class) into one task. Exact sample
sizes come from a stored table of keys: counts per hash prefix and one ranked
prefix give the last row of a sample, and the sample is a filter with literals.
Dense positions are those of rows written in order, plus the offset of their
partition (one number per partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, materialize


def seeded_key(seed: int | str, *cols) -> Column:
    """Deterministic shuffle key ``md5('<seed>:<col>')`` (same in DuckDB)."""
    parts = [F.lit(f"{seed}:")]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(":"))
        parts.append(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    return F.md5(F.concat(*parts))


#: Rows of a group's border prefix that are ranked at most; a longer prefix is taken beyond.
RANKED = 10_000
_DIGITS, _LENGTH = 4, 32  # hex digits a step, of the key


def _borders(keys: DataFrame, need: dict, kind: str) -> dict:
    """For each group the (hash, key) of its ``need``-th row in hash order,
    None if it has fewer rows. ``keys(_g, _h, _key)`` is a stored table.

    Counts per hash prefix give the prefix that holds the row, four digits at a
    time, until few rows share it; those are ranked. One row per requested
    group comes to the driver each time."""
    spark = keys.sparkSession
    left, found = {g: ("", n) for g, n in need.items() if n > 0}, {g: None for g in need}
    while left:
        at = spark.createDataFrame([(g, p, len(p), int(n)) for g, (p, n) in left.items()], f"_g {kind}, _p string, _len int, _need long")
        rows = keys.join(F.broadcast(at), "_g").where(F.col("_h").startswith(F.col("_p")))  # the requested groups
        step = F.substring(F.col("_h"), F.col("_len") + 1, F.lit(_DIGITS))
        per = rows.groupBy("_g", "_p", "_need", step.alias("_s")).agg(F.count("*").alias("_n"))
        per = per.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_g").orderBy("_s")))  # 65536 rows a group at most
        border = per.where("_upto >= _need and _upto - _n < _need").collect()
        left, rank = {}, {}
        for r in border:
            place = r["_p"] + r["_s"], r["_need"] - r["_upto"] + r["_n"]
            (rank if r["_n"] <= RANKED or len(place[0]) >= _LENGTH else left)[r["_g"]] = place
        if rank:
            at = spark.createDataFrame([(g, p, int(n)) for g, (p, n) in rank.items()], f"_g {kind}, _p string, _need long")
            rows = keys.join(F.broadcast(at), "_g").where(F.col("_h").startswith(F.col("_p")))
            rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy("_h", "_key"))).where("_i = _need")
            found.update({r["_g"]: (r["_h"], r["_key"]) for r in rows.collect()})
    return found


def _upto(h: Column, key: str, border: tuple | None) -> Column:
    if border is None:
        return F.lit(True)
    return (h < border[0]) | ((h == border[0]) & (F.col(key) <= F.lit(border[1])))


def _stored_keys(df: DataFrame, group: Column, key: str, seed: int) -> DataFrame:
    return materialize(df.select(group.alias("_g"), seeded_key(seed, key).alias("_h"), F.col(key).alias("_key")), "sample-keys")


def sample_per_class(df: DataFrame, label: str | Sequence[str], sizes: dict, key: str, seed: int = 42) -> DataFrame:
    """O1: for each class value ``v`` in ``sizes``, the first ``sizes[v]`` rows
    in seeded-shuffle order (ties broken by ``key``). ``label`` may name several
    columns; the classes are then tuples.

    Class, hash and key are stored once; the last row of each class is found on
    them, and the sample is a filter of ``df`` with literals."""
    if isinstance(label, str):
        group, kind, need = F.col(label), df.schema[label].dataType.simpleString(), sizes
    else:
        group, kind = F.concat_ws("/", *[F.col(c).cast("string") for c in label]), "string"
        need = {"/".join(map(str, v)): n for v, n in sizes.items()}
    borders = _borders(_stored_keys(df, group, key, seed), need, kind)
    h, take = seeded_key(seed, key), F.lit(False)
    for g, border in borders.items():
        if need[g] > 0:
            take = take | ((group == F.lit(g)) & _upto(h, key, border))
    return df.where(take)


def class_filter(df: DataFrame, label: str, value: int = 1) -> DataFrame:
    """Rows of one class; all rows when the class has no member (looked
    for first, in the label column alone)."""
    known = df.select(F.max((F.col(label) == value).cast("int")).alias("n")).first()["n"]
    return df.where(F.col(label) == value) if known else df


def dense_id(df: DataFrame, order_by: Sequence[str], out_col: str = "_idx") -> DataFrame:
    """U4: 0-based dense position in ``order_by`` order (must be a total order).

    The rows are range-sorted and written once; the partitions are then fixed,
    and a position is the offset of the partition plus the place inside it. No
    row is joined back.
    """
    pid, mid, off, n = "_pid", "_mid", "_off", "_n"
    rows = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    rows = materialize(rows.withColumn(pid, F.spark_partition_id()).withColumn(mid, F.monotonically_increasing_id()), "sorted-rows")
    # one row per partition: bounded by the partition count, safe to broadcast
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(pid).agg(F.count("*").alias(n)).select(pid, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    place = F.col(mid) - F.shiftleft(F.col(pid).cast("long"), 33)
    return rows.join(F.broadcast(offsets), pid).withColumn(out_col, (F.col(off) + place).cast("long")).drop(pid, mid, off)


def train_val_split(df: DataFrame, frac: float, key: str, seed: int = 42,
                    out_col: str = "split") -> DataFrame:
    """O2: exactly ``ceil(n * frac)`` rows marked 'val' (smallest seeded
    keys), the rest 'train'. ``key`` is unique."""
    keys = _stored_keys(df, F.lit(0), key, seed)
    need = keys.select(F.ceil(F.count("*") * F.lit(frac)).cast("long").alias("n")).first()["n"]
    val = _upto(seeded_key(seed, key), key, _borders(keys, {0: need}, "int")[0]) if need else F.lit(False)
    return df.withColumn(out_col, F.when(val, "val").otherwise("train"))


def validation_slice(df: DataFrame, train: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """O3: ``n`` rows not used for training (anti join on ``key``), the first
    in seeded order."""
    used = materialize(train.select(key).distinct(), "train-keys")
    rest = df.join(broadcast_if_small(used), key, "left_anti")
    if n <= 0:
        return rest.limit(0)
    border = _borders(_stored_keys(rest, F.lit(0), key, seed), {0: n}, "int")[0]
    return rest.where(_upto(seeded_key(seed, key), key, border))


def contiguous_split(df: DataFrame, k: int, order_by: Sequence[str], out_col: str = "part") -> DataFrame:
    """K contiguous parts in ``order_by`` order; each part has n // k rows
    and the remainder goes to the last part (all rows to the last part when
    n < k). Positions are found on the order columns; the rows are compared
    with the k - 1 rows that begin a part (``order_by`` is a total order)."""
    ids = dense_id(df.select(*order_by), order_by, "_i")
    n = df.select(F.count("*").alias("n")).scalar()
    chunk = F.floor(n / k)
    begins = ids.where((chunk > 0) & (F.col("_i") > 0) & (F.col("_i") < chunk * k) & (F.col("_i") % chunk == 0))
    at = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(order_by)])
    begins = begins.agg(F.collect_list(at).alias("_b")).scalar()  # k - 1 rows
    df = df.withColumn("_b", begins)
    part = F.lit(0)
    for j in range(k - 1):
        part = part + F.coalesce((F.get("_b", F.lit(j)) <= at).cast("int"), F.lit(0))
    return df.withColumn(out_col, F.when(chunk > 0, part).otherwise(F.lit(k - 1)).cast("int")).drop("_b")


def align_positional(left: DataFrame, right: DataFrame, left_order: Sequence[str],
                     right_order: Sequence[str], right_cols: Sequence[str], pad: str = "") -> DataFrame:
    """Pair rows by position; the right side is cut to the left's length
    and missing right values become ``pad``."""
    li = dense_id(left, left_order, "_pos")
    ri = dense_id(right.select(*right_order, *[c for c in right_cols if c not in right_order]),
                  right_order, "_pos").select("_pos", *right_cols)
    out = li.join(ri, "_pos", "left")
    for c in right_cols:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(pad)))
    return out


def union_parts(parts: Sequence[DataFrame], part_col: str | None = None) -> DataFrame:
    """Bag union by column name; optional part number column keeps
    the part order explicit."""
    out = None
    for i, p in enumerate(parts):
        if part_col:
            p = p.withColumn(part_col, F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out
