"""Hashed word features: TF-IDF similarity (M6) and a logistic classifier (M1).

Words are hashed into a fixed number of buckets, so a text is a short sparse
vector inside its row and a corpus is summed up in one number per bucket. The
number of buckets, not the vocabulary, bounds what is shuffled, broadcast or
held by the driver; words that share a bucket count as one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _c, _let
from ..session import materialize
from .scoring import DEFAULT_TOKEN_PATTERN, tokens

#: Buckets of a TF-IDF vector.
BUCKETS = 1 << 14


def bucket_counts(a: Column, b: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of two word arrays and how often each holds them,
    ``array<struct<w int, x int, y int>>`` in bucket order; null has no words.

    A word's bucket is the first 32 bits of its md5 (the same in SQL), taken once
    for each distinct word of an Arrow batch."""
    from pyspark.sql.functions import arrow_udf

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        code = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode()
        of = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % buckets for w in code.dictionary.to_pylist()], np.int64)
        text = np.concatenate([np.repeat(np.arange(len(x)), pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False)) for x in (a, b)])
        place, at = np.unique(text * buckets + of[code.indices.to_numpy()], return_inverse=True)
        m = len(a.flatten())
        n = [np.bincount(at[part], minlength=len(place)) for part in (slice(0, m), slice(m, None))]
        ends = np.cumsum(np.bincount(place // buckets, minlength=len(a)))
        rows = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in (place % buckets, *n)], names=["w", "x", "y"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), rows)

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return arrow_udf(run, "array<struct<w:int,x:int,y:int>>")(a, b)


def train_idf(corpus: DataFrame, text_col: str = "text", buckets: int = BUCKETS, pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """One row ``idf array<double>``, a weight per bucket:
    ``ln((n + 1) / (df + 1))`` with n texts, df of them with the bucket.

    The buckets of a text are counted once each; a task sends at most one row
    per bucket."""
    none = F.array().cast("array<string>")
    there = corpus.select(F.transform(bucket_counts(tokens(text_col, pattern), none, buckets), lambda x: x["w"].cast("long")).alias("b"))
    # the bucket -1 counts the texts
    found = there.select(F.explode(F.concat(F.array(F.lit(-1).cast("long")), F.coalesce("b", F.array().cast("array<bigint>")))).alias("b"))
    df = materialize(found.groupBy("b").agg(F.count("*").alias("df")), "idf-counts")
    every = corpus.sparkSession.range(-1, buckets).withColumnRenamed("id", "b")
    rows = every.join(df, "b", "left").select("b", F.coalesce("df", F.lit(0)).alias("df"))
    line = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "df"))), lambda x: x["df"]).alias("dfs"))  # buckets + 1 numbers
    return line.select(_let(F.col("dfs"), lambda d: F.transform(F.slice(d, 2, buckets), lambda x: F.log((F.get(d, F.lit(0)) + 1) / (x + 1)))).alias("idf"))


def tfidf_similarity(a, b, idf: Column, buckets: int = BUCKETS, pattern: str = DEFAULT_TOKEN_PATTERN) -> Column:
    """M6: cosine of the TF-IDF vectors of two texts; 0 if one has no word of
    any weight. ``idf`` is the array of :func:`train_idf`, best as a column
    that holds the scalar subquery ``train_idf(...).scalar()``."""
    zero = F.lit(0.0)

    def add(acc, e):
        def go(i):  # words that all texts have weigh nothing
            x, y = e["x"] * i, e["y"] * i
            return F.struct((acc["x"] + x * x).alias("x"), (acc["y"] + y * y).alias("y"), (acc["d"] + x * y).alias("d"))
        return _let(F.coalesce(F.get(idf, e["w"]), zero), go)

    def cosine(s):
        return F.when((s["x"] == 0) | (s["y"] == 0), zero).otherwise(s["d"] / (F.sqrt(s["x"]) * F.sqrt(s["y"])))
    start = F.struct(zero.alias("x"), zero.alias("y"), zero.alias("d"))
    return _let(F.aggregate(bucket_counts(tokens(a, pattern), tokens(b, pattern), buckets), start, add), cosine)


# --- M1 as a logistic regression ---------------------------------------------------

#: Features of the classifier, its ridge penalty and its most steps.
FEATURES, PENALTY, STEPS = 1 << 18, 0.01, 50


def _hashed(df: DataFrame, text_col: str, pattern: str, features: int) -> DataFrame:
    from pyspark.ml.feature import HashingTF
    words = df.withColumn("_words", F.coalesce(tokens(text_col, pattern), F.array().cast("array<string>")))
    return HashingTF(inputCol="_words", outputCol="_features", numFeatures=features, binary=True).transform(words)


def train_logistic(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", pattern: str = DEFAULT_TOKEN_PATTERN,
                   features: int = FEATURES, penalty: float = PENALTY, steps: int = STEPS):
    """A logistic regression over hashed words, fitted by Spark's distributed
    optimiser: a step is one pass over the labelled rows and a tree of sums of
    ``features`` numbers. Rows without a label are left out; both classes must
    occur."""
    from pyspark.ml.classification import LogisticRegression
    rows = _hashed(labelled.where(F.col(label_col).isNotNull()), text_col, pattern, features)
    rows = rows.select("_features", F.col(label_col).cast("double").alias("_label"))
    return LogisticRegression(featuresCol="_features", labelCol="_label", regParam=penalty, maxIter=steps, tol=1e-9, standardization=False).fit(rows)


def score_logistic(df: DataFrame, model, text_col: str = "text", out_col: str = "p_toxic", pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """M1: ``out_col`` = the model's probability, row by row without a shuffle."""
    from pyspark.ml.functions import vector_to_array
    scored = model.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_prediction").transform(
        _hashed(df, text_col, pattern, model.numFeatures))
    return scored.withColumn(out_col, vector_to_array("_probability")[1]).drop("_words", "_features", "_raw", "_probability", "_prediction")
