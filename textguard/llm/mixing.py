"""Mixing sources to target weights by a low-discrepancy schedule.

Method: the mix is a sequence of slots of equally many words. Slot i draws
the point frac(i * golden ratio) and takes the source whose cumulative target
share holds it, so every stretch of the schedule has every source near its
share. The documents of a source stand in a shuffled order, cut into blocks of
a slot's size; the source's r-th slot takes block r modulo its blocks. A
source that is wanted more often than it has blocks is gone through again, at
most ``MAX_EPOCHS`` times.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating, and
share ``BUDGET`` times all words; a target stops at ``MAX_EPOCHS`` times its
source, the excess goes to the others by weight until none is above (closed
form: the water level at which the capped shares add up).

How it is dealt out: one row per source passes through one task (its targets
need all sources); documents and slots never do. Positions in a source and ranks of slots are prefix sums
in two levels, inside buckets of a source (hash ranges; runs of slots) and over
the bucket totals, so a source with a third of all rows is many groups.
All points and thresholds are integers, so reruns agree bit by bit.

Edge cases: size counts words, runs of anything but white space; null and
empty texts have size 0 and are not taken; a null source is a source of its
own; a null doc_id is shuffled as the empty id; ties in the shuffled order go
by doc_id and size; with no words every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, store, stored, to_int

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
#: Words of a slot: the largest of 1, 2, 4, ... BLOCK of which a target has 512 slots.
BLOCK, SLOTS_PER_TARGET = 4096, 512
SLOT_SIZES = tuple(1 << i for i in range(BLOCK.bit_length()))
#: 2**32 / golden ratio, odd: i * GOLDEN mod 2**32 is the golden-ratio sequence.
GOLDEN, POINTS = 2654435769, 1 << 32
#: Threshold cells: a slot meets only the sources that touch its cell.
CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(key: Column) -> Column:
    """52 bits of the md5 of the id, the shuffled order."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: source, words, target, block (words of a slot), and among
    the sources of that block first and last point of its share and slots."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("words"))
    # one row a source from here on
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = per.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    w = w.withColumn("cap", F.col("words") * MAX_EPOCHS)
    everything = W.partitionBy()
    w = w.withColumn("budget", F.sum("words").over(everything) * BUDGET)
    # water level: in order of cap / weight, close the sources one by one; the level rises as long as the
    # closed ones are above their cap and falls after, so the highest is the one at which all fits
    by_level = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    w = w.withColumn("level", (F.col("budget") - (F.sum("cap").over(by_level) - F.col("cap"))) / (F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight")))
    w = w.withColumn("level", F.max("level").over(everything))
    w = w.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    fitting = [F.when(F.col("target") >= b * SLOTS_PER_TARGET, b) for b in SLOT_SIZES]
    w = w.withColumn("block", F.coalesce(F.greatest(*fitting), F.lit(1)).cast("long"))
    alike = W.partitionBy("block")
    total = F.sum("target").over(alike)
    in_order = W.partitionBy("block").orderBy("rank")
    upto = F.sum("target").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
    w = w.withColumn("hi", F.floor(F.when(total > 0, upto / total).otherwise(0.0) * POINTS).cast("long"))
    w = w.withColumn("lo", F.coalesce(F.lag("hi").over(in_order), F.lit(0)))
    w = w.withColumn("slots", F.ceil(total / F.col("block")).cast("long"))
    return w.select("source", "words", "target", "lo", "hi", "block", "slots")


def _bucket_size(rows: int) -> int:
    """Rows of a prefix-sum bucket: both levels grow with the square root."""
    return max(128, math.isqrt(max(0, rows)))


def schedule(goals: DataFrame) -> DataFrame:
    """The mix: (slot, block, source, rank, piece); ``piece`` is the block of
    the source that the slot takes; slots count from 0 among those of one
    length. Slots whose source is used up are left out."""
    cell = POINTS // CELLS
    touched = goals.where("hi > lo").select("source", "block", "lo", "hi", "words", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    slots = None
    for block, n in goals.groupBy("block").agg(F.max("slots")).orderBy("block").collect():  # 13 lengths at most
        run = _bucket_size(to_int(n))
        one = goals.sparkSession.range(to_int(n)).select(F.lit(block).cast("long").alias("block"), F.col("id").alias("slot"), (F.col("id") * GOLDEN % POINTS).alias("point"),
                                                         F.floor(F.col("id") / run).alias("run"))
        slots = one if slots is None else slots.unionAll(one)
    if slots is None:
        return goals.select(F.lit(0).cast("long").alias("slot"), "block", "source", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("piece")).limit(0)
    hit = (slots.withColumn("cell", F.floor(F.col("point") / cell)).join(stored(touched, "cells").small(), ["block", "cell"])
           .where("point >= lo and point < hi").select("slot", "run", "source", "words", "block"))
    before = hit.groupBy("source", "run").agg(F.count("*").alias("n"))  # a source has slots of one length
    before = before.select("source", "run", (F.sum("n").over(W.partitionBy("source").orderBy("run")) - F.col("n")).alias("before"))
    inside = W.partitionBy("source", "run").orderBy("slot")
    ranked = hit.withColumn("r", F.row_number().over(inside) - 1).join(before.withColumnRenamed("source", "s").withColumnRenamed("run", "u"),
                                                                      F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("u")))
    blocks = F.ceil(F.col("words") / F.col("block"))
    return (ranked.withColumn("rank", F.col("r") + F.col("before")).where(F.col("rank") < blocks * MAX_EPOCHS)
            .select("slot", "block", "source", "rank", (F.col("rank") % blocks).alias("piece")))


def placed(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``start``, the words before each document in the
    shuffled order of its source."""
    n = sizes.count()
    buckets = max(1, n // _bucket_size(n))
    rows = sizes.withColumn("h", shuffle_key(F.col("doc_id"))).withColumn("bucket", F.floor(F.col("h") / ((1 << 52) / buckets)).cast("long"))
    before = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = before.select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                           (F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (rows.withColumn("upto", F.sum("size").over(inside))
            .join(before, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
            .withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("s", "b", "before", "upto", "h", "bucket"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes with targets, takes, goals). ``takes``: one row per stretch of a
    document in a block and epoch that the mix takes: row, doc_id, slot epoch,
    first and last word (of the document, end exclusive)."""
    sizes = stored(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                               F.xxhash64(text).alias("row")), "sizes").df
    goals = stored(targets(sizes), "goals")
    uses = schedule(goals.df).groupBy("source", "piece").agg(F.count("*").alias("uses"))
    at = store(placed(sizes), "placed")
    block = F.col("block")
    length = goals.small().select(F.col("source").alias("of"), "block")
    cut = (at.where("size > 0").join(length, F.col("source").eqNullSafe(F.col("of"))).withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
           .withColumn("first", F.greatest(F.col("start"), F.col("piece") * block) - F.col("start"))
           .withColumn("last", F.least(F.col("start") + F.col("size"), (F.col("piece") + 1) * block) - F.col("start")))
    uses = uses.select(F.col("source").alias("s"), F.col("piece").alias("p"), "uses")
    takes = cut.join(uses, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p"))).select(
        "doc_id", "source", "row", "size", "start", "first", "last", "uses")
    return at, takes, goals.df


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken."""
    at, takes, goals = mix(docs, key, text, source)
    taken = takes.select("doc_id", "source", "row", "size", "start", ((F.col("last") - F.col("first")) * F.col("uses")).alias("taken"))
    none = at.select("doc_id", "source", "row", "size", "start", F.lit(0).cast("long").alias("taken"))
    # equal rows share a start only if their size is 0: count rows to keep each
    rows = taken.unionAll(none).groupBy("doc_id", "source", "row", "size", "start").agg(F.sum("taken").alias("taken"), F.count_if(F.col("taken") == 0).alias("n"))
    per = goals.select(F.col("source").alias("s"), F.col("words").alias("source_size"), "target")
    return (rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(F.col("size") == 0, F.col("n")).otherwise(1).cast("long"))))
            .join(stored(per, "per-source").small(), F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "size", "source_size", "target", "taken"))


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", length: str | None = None) -> DataFrame:
    """The mix as rows of ``docs``: one per document and epoch in which it is
    taken. A document at the edge of the taken blocks is taken in part: its
    text is then the words taken, joined by one space (``length``, if named,
    is set anew). Rows equal in id, source and text get the same picks."""
    _, takes, _ = mix(docs, key, text, source)
    i, s, r, epoch, first, last, size, new_text = fresh(docs, "_id", "_source", "_row", "_epoch", "_first", "_last", "_size", "_text")
    picks = (takes.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
             .groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("row").alias(r), epoch)
             .agg(F.min("first").alias(first), F.max("last").alias(last), F.max("size").alias(size)))
    on = F.col(key).eqNullSafe(F.col(i)) & F.col(source).eqNullSafe(F.col(s)) & (F.xxhash64(text) == F.col(r))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    part = F.array_join(F.slice(words, (F.col(first) + 1).cast("int"), (F.col(last) - F.col(first)).cast("int")), " ")
    cut = F.col(last) - F.col(first) < F.col(size)
    out = docs.join(stored(picks, "picks").small(), on).withColumn(new_text, F.when(cut, part).otherwise(F.col(text)))
    new = {text: F.col(new_text)} | ({length: F.when(cut, F.char_length(new_text)).otherwise(F.col(length)).cast(docs.schema[length].dataType)} if length else {})
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def _sql() -> str:
    case = "CASE (r % 3) " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"
    return f"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS words FROM sizes GROUP BY source),
w AS (SELECT *, {case} AS weight, words * {MAX_EPOCHS} AS cap, (SELECT sum(words) FROM per) * {BUDGET} AS budget
      FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM per)),
lv AS (SELECT *, (budget - (sum(cap) OVER o - cap)) / ((SELECT sum(weight) FROM w) - sum(weight) OVER o + weight) AS lvl
       FROM w WINDOW o AS (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tg AS (SELECT *, least(CAST(cap AS DOUBLE), (SELECT max(lvl) FROM lv) * weight) AS target FROM lv),
bl AS (SELECT *, CAST(coalesce(list_max(list_filter([{', '.join(map(str, SLOT_SIZES))}], lambda b: target >= b * {SLOTS_PER_TARGET})), 1) AS BIGINT) AS block FROM tg),
pt AS (SELECT *, CAST(floor((SELECT sum(t2.target) FROM bl t2 WHERE t2.r <= bl.r AND t2.block = bl.block) / (SELECT sum(target) FROM bl t3 WHERE t3.block = bl.block) * {POINTS}) AS BIGINT) AS hi FROM bl),
goals AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY block ORDER BY r), 0) AS lo FROM pt),
slots AS (SELECT block, i, (i * {GOLDEN}) % {POINTS} AS point FROM (SELECT block, unnest(range(CAST(ceil(sum(target) / block) AS BIGINT))) AS i FROM goals GROUP BY block)),
ranked AS (SELECT r, words, goals.block, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS k FROM slots JOIN goals ON goals.block = slots.block AND point >= lo AND point < hi),
uses AS (SELECT r, k % CAST(ceil(words / block) AS BIGINT) AS piece, count(*) AS n FROM ranked
         WHERE k < CAST(ceil(words / block) AS BIGINT) * {MAX_EPOCHS} GROUP BY ALL),
placed AS (SELECT s.*, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM sizes s),
cut AS (SELECT p.*, g.r, g.words, g.target, g.block, unnest(range(CAST(floor(start / block) AS BIGINT), CAST(floor((start + greatest(size, 1) - 1) / block) AS BIGINT) + 1)) AS piece
        FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source)
SELECT c.doc_id, c.size, c.words AS source_size, c.target,
       CAST(sum((least(start + size, (c.piece + 1) * block) - greatest(start, c.piece * block)) * coalesce(n, 0)) AS BIGINT) AS taken
FROM cut c LEFT JOIN uses u ON c.r = u.r AND c.piece = u.piece
GROUP BY c.doc_id, c.h, c.start, c.size, c.words, c.target"""


SQL = _sql()
