"""Structured Streaming variants of the stateless cleaning and gating flow.

All of the cleaning, scoring and gating operators are per-row expressions,
so they apply unchanged to a streaming DataFrame. The query below reads
Parquet files as they arrive, cleans, scores, gates, edits and writes the
rewrites with exactly-once file-sink semantics (checkpointed offsets).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..session import ensure_checkpoint_dir


def gated_stream(src: DataFrame, terms, patterns, threshold: float = 1.0) -> DataFrame:
    """C4 -> P6 score -> P1 gate -> G1 (C9b on gated rows) -> G2."""
    score = P.term_hits("text", terms).cast("double")
    gate = score >= threshold
    out = F.when(gate, T.drop_toxic_tokens("text", terms)).otherwise(T.cleanse("text", terms, patterns))
    return src.select("doc_id", P.fallback(out, F.col("text")).alias("rewrite"), gate.alias("edited"))


def documents_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The documents table as a file stream."""
    src_path = os.path.join(sf_dir, "documents.parquet")
    schema = spark.read.parquet(src_path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if spark.read.parquet(src_path).inputFiles()[0].endswith("/documents.parquet"):
        # one file among the tables: keep it alone
        return reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    return reader.parquet(src_path)


def run_gated_stream(spark: SparkSession, sf_dir: str, terms, patterns,
                     out_dir: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Run :func:`gated_stream` over ``<sf_dir>/documents.parquet`` with an
    ``availableNow`` trigger and return the sink as a batch DataFrame. By
    default one micro-batch takes all files there are; the caller may limit
    them."""
    base = out_dir or os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")
    stream = documents_stream(spark, sf_dir, max_files_per_trigger)
    q = (gated_stream(stream, terms, patterns).writeStream.format("parquet")
         .option("path", os.path.join(base, "out"))
         .option("checkpointLocation", os.path.join(base, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))


def run_pivot_stream(spark: SparkSession, stream: DataFrame, gate, text: str, out_col: str, stages, caches: dict,
                     base: str, batch_size: int = 16) -> DataFrame:
    """M4 on a stream with a cache per stage (``operators.caches``): every
    micro-batch is edited with the answers of all earlier ones at hand. A batch
    that is replayed after a failure finds its own answers in the caches, adds
    no entry, and writes its folder of the sink (``batch=<id>``) anew, so the
    sink holds each row once. Runs what there is (``availableNow``) and returns
    the sink."""
    from ..operators.caches import cached_stages
    out = os.path.join(base, "out")

    def edit(batch: DataFrame, batch_id: int) -> None:
        done = cached_stages(batch, gate, text, out_col, stages, caches, batch_size)
        done.write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}"))

    query = stream.writeStream.foreachBatch(edit).option("checkpointLocation", os.path.join(base, "ckpt")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")
