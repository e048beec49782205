"""Result caches as bucketed tables, and model stages behind them.

A cache is a table of ``key, value`` (the content hash of a text and a model's
answer), bucketed and sorted by the key. A lookup therefore shuffles the keys
it asks for and never the cache, however large that has grown. Answers are
appended; :meth:`BucketedCache.compact` folds the appended files of each
bucket into one sorted file again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import _c
from ..session import materialize
from .gate import BatchFn, batch_map, content_key

#: Buckets of a cache table: the tasks that read it. Fixed when it is made.
BUCKETS = 64


class BucketedCache:
    """A cache table of the session's catalog, made by the first append."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def read(self) -> DataFrame | None:
        if not self.exists():
            return None
        self.spark.catalog.refreshTable(self.name)  # another session, as of a micro-batch, may have appended
        return self.spark.table(self.name).select("key", "value")

    def _write(self, df: DataFrame, name: str, mode: str) -> None:
        # one file per bucket and write, not one per bucket and task
        rows = df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")).repartition(self.buckets, "key")
        rows.write.mode(mode).bucketBy(self.buckets, "key").sortBy("key").format("parquet").saveAsTable(name)

    def append(self, entries: DataFrame) -> None:
        """Add ``entries(key, value)`` whose key is not there yet, so a batch
        that is run again adds nothing."""
        new = entries.where(F.col("key").isNotNull()).groupBy("key").agg(F.min(F.struct(F.col("value").cast("string").alias("v"))).alias("s")).select("key", "s.v")
        new = new.withColumnRenamed("v", "value")
        have = self.read()
        if have is not None:
            new = new.join(have.select("key"), "key", "left_anti")
            new = materialize(new, "cache-new")  # a table cannot be read while it is written
            if new.isEmpty():
                return
        self._write(new, self.name, "append")

    def add(self, entries: DataFrame) -> None:
        """Add ``entries(key, value)``, one per key and none that has a value
        there; null values are left out, so their keys are asked for again.
        ``entries`` may read this cache: they see it as it is before."""
        self._write(entries.where(F.col("value").isNotNull()), self.name, "append")

    def compact(self) -> None:
        """One sorted file per bucket, one value per key (the smallest)."""
        have = self.read()
        if have is None:
            return
        whole = f"{self.name}_compacted"
        self.spark.sql(f"DROP TABLE IF EXISTS {whole}")
        one = have.groupBy("key").agg(F.min(F.struct(F.col("value").alias("v"))).alias("s")).select("key", F.col("s.v").alias("value"))
        self._write(one, whole, "errorifexists")
        self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"ALTER TABLE {whole} RENAME TO {self.name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def cached_stages(df: DataFrame, gate, text: str, out_col: str, stages: Sequence[tuple[str, Callable[[], BatchFn]]],
                  caches: dict[str, BucketedCache], batch_size: int = 16) -> DataFrame:
    """M4 with J3 between all stages: the gated texts go through the models of
    ``stages`` (name, factory) one after the other; every stage looks its
    distinct input texts up in its own cache, runs its model on the ones that
    are missing, once each, and appends the answers. Other rows keep ``text``;
    a gated null stays null.

    Texts are followed by the content hash of the first one, so a stage moves
    the texts it is asked for once, to the buckets of its cache, and its answers
    once, into them. The rows that are gated meet the last answers by that hash;
    the others meet nothing."""
    g = F.coalesce(_c(gate) if not isinstance(gate, str) else F.col(gate), F.lit(False))
    gated = df.withColumn("_gate", g)
    asked = F.col("_gate") & F.col(text).isNotNull()
    flow = gated.where(asked).select(content_key(text).alias("_from"), F.col(text).alias("_t")).dropDuplicates(["_from"])
    flow = materialize(flow, "stage-texts")
    for name, factory in stages:
        cache, keyed = caches[name], flow.withColumn("_k", content_key("_t"))
        missing, have = keyed.where(F.col("_k").isNotNull()).select("_k", "_t"), cache.read()
        if have is not None:
            missing = missing.join(have.where(F.col("value").isNotNull()).select(F.col("key").alias("_k")), "_k", "left_anti")
        missing = missing.dropDuplicates(["_k"])
        cache.add(batch_map(missing, factory, "_t", "value", batch_size).select(F.col("_k").alias("key"), "value"))
        answers = cache.read().groupBy(F.col("key").alias("_k")).agg(F.min("value").alias("_t"))
        flow = materialize(keyed.select("_from", "_k").join(answers, "_k", "left").select("_from", "_t"), f"stage-{name}")
    last = flow.withColumnRenamed("_t", "_to")
    columns = [*dict.fromkeys([*df.columns, out_col])]
    edited = gated.where(asked).withColumn("_from", content_key(text)).join(last, "_from", "left").withColumn(out_col, F.col("_to"))
    rest = gated.where(~asked).withColumn(out_col, F.col(text))
    return edited.select(*columns).unionByName(rest.select(*columns))
