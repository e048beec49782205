"""Vector operators on ``array<float>`` embedding columns (V1-V6, A8, A9,
J5, M9).

Class means use ``Summarizer.mean`` (one dense-vector partial aggregate per
group and task, no per-element explode). Everything that is broadcast here is
bounded by construction: one mean vector per (layer, class) and the
user-given parameter grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import _at, _c, _let


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """V1: cosine of two vectors (of their L2-normalised forms); 0 for a zero vector."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den).otherwise(F.lit(0.0))


def last_token(states, mask) -> Column:
    """V2: the element of ``states`` at the last position whose mask is 1
    (correct for left and right padding); null when the mask is all 0."""
    pos = F.array_max(F.filter(F.transform(_c(mask), lambda m, i: F.when(m == 1, i + 1)),
                               lambda i: i.isNotNull()))
    return _at(_c(states), pos)


def shift(h, delta, alpha) -> Column:
    """V4: ``h - alpha * delta`` element-wise (alpha is signed)."""
    a = _c(alpha) if not isinstance(alpha, (int, float)) else F.lit(float(alpha))
    return F.zip_with(_c(h), _c(delta), lambda x, d: x.cast("double") - a * d.cast("double"))


def softmax(logits) -> Column:
    """V5: softmax of a logit array (max-shifted for stability)."""
    def go(z):
        m = F.array_max(z)
        e = F.transform(z, lambda x: F.exp(x - m))
        return _let(e, lambda ee: F.transform(ee, lambda x: x / F.aggregate(ee, F.lit(0.0), lambda a, y: a + y)))
    return _let(F.transform(_c(logits), lambda x: x.cast("double")), go)


def prob_class1(logits) -> Column:
    """V5: probability of class 1 from two logits (= sigmoid(z1 - z0))."""
    z = _c(logits)
    return 1.0 / (1.0 + F.exp(_at(z, 1).cast("double") - _at(z, 2).cast("double")))


def parse_int_range(spec: str) -> list[int]:
    """V6: "21-31" -> [21..31]; "3,5,9" -> [3, 5, 9]."""
    spec = spec.strip()
    if "-" in spec and "," not in spec:
        lo, hi = spec.split("-", 1)
        return list(range(int(lo), int(hi) + 1))
    return [int(x) for x in spec.split(",") if x.strip()]


def parse_float_list(spec: str) -> list[float]:
    """V6: "1.0,2.0,4.0" -> [1.0, 2.0, 4.0]."""
    return [float(x) for x in spec.split(",") if x.strip()]


def class_means(df: DataFrame, vec: str, by: Sequence[str]) -> DataFrame:
    """Mean vector per group as ``array<double>`` plus the row count."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = df.select(*by, array_to_vector(F.col(vec)).alias("_v"))
    return (v.groupBy(*by).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count("*").alias("n"))
            .select(*by, vector_to_array("_m").alias("mean"), "n"))


def _both(means: DataFrame, cls: str, by: Sequence[str], positive, negative) -> DataFrame:
    """One row per group: means and sizes of both classes as columns (one
    aggregation; groups that lack a class are left out)."""
    pick = lambda value, c: F.max(F.when(F.col(cls) == value, F.struct(F.col(c).alias("x"))))["x"]
    return means.groupBy(*by).agg(pick(positive, "mean").alias("mp"), pick(negative, "mean").alias("mn"),
                                  pick(positive, "n").alias("n_pos"), pick(negative, "n").alias("n_neg")).where("mp is not null and mn is not null")


def diff_in_means(means: DataFrame, cls: str, by: Sequence[str] = (), positive=1, negative=0) -> DataFrame:
    """V3: ``mean(negative class) - mean(positive class)`` per group (the
    direction from the toxic mean to the non-toxic one), with class sizes."""
    return _both(means, cls, by, positive, negative).select(*by, F.zip_with("mn", "mp", lambda a, b: a - b).alias("delta"), "n_pos", "n_neg")


def param_grid(spark, layers: Sequence[int], alphas: Sequence[float]) -> DataFrame:
    """The (layer, alpha) grid with its enumeration order."""
    rows = [(i, int(l), float(a)) for i, (l, a) in enumerate((l, a) for l in layers for a in alphas)]
    return spark.createDataFrame(rows, "grid_order int, layer int, alpha double")


def grid_search(vectors: DataFrame, means: DataFrame, grid: DataFrame, layer: str, vec: str,
                cls: str, k: int, positive=1, negative=0,
                sim_weight: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """M9 on embeddings: for each grid point shift every vector of its layer
    by ``-alpha * delta``; the shifted vector counts as detoxified when it is
    closer (cosine) to the non-toxic than to the toxic mean; sta = share
    detoxified, sim = mean cosine(original, shifted), score = sta +
    sim_weight * sim. Returns ``(all candidates, top k)``.

    No vector is shifted: with s = h - alpha d every cosine follows from the
    dot products h.h, h.d, h.mu+, h.mu- of a vector and d.d, d.mu+, d.mu-,
    |mu+|, |mu-| of its layer. A vector meets its layer once, its five numbers
    then meet the alphas of the layer (the grid), and the only shuffle carries
    partial aggregates. Means of layers outside the grid are dropped first, so
    what is broadcast is bounded by the grid.
    """
    from .select import top_k
    layers = F.broadcast(grid.select(layer).distinct())
    both = _both(means.join(layers, layer, "left_semi"), cls, [layer], positive, negative)
    d = both.withColumn("d", F.zip_with("mn", "mp", lambda a, b: a - b))
    d = d.select(layer, "d", "mp", "mn", dot("d", "d").alias("dd"), dot("d", "mp").alias("dp"), dot("d", "mn").alias("dn"),
                 norm("mp").alias("np"), norm("mn").alias("nn"))
    h = vectors.select(layer, F.col(vec).alias("_h")).join(F.broadcast(d), layer)
    h = h.select(layer, dot("_h", "_h").alias("hh"), dot("_h", "d").alias("hd"), dot("_h", "mp").alias("hp"), dot("_h", "mn").alias("hn"),
                 "dd", "dp", "dn", "np", "nn")
    j = h.join(F.broadcast(grid), layer)
    a = F.col("alpha")
    size = F.sqrt(F.greatest(F.col("hh") - 2 * a * F.col("hd") + a * a * F.col("dd"), F.lit(0.0)))
    cos = lambda x, den: F.when(den > 0, x / den).otherwise(0.0)
    j = j.withColumn("_size", size)
    detox = cos(F.col("hn") - a * F.col("dn"), F.col("_size") * F.col("nn")) > cos(F.col("hp") - a * F.col("dp"), F.col("_size") * F.col("np"))
    same = cos(F.col("hh") - a * F.col("hd"), F.sqrt("hh") * F.col("_size"))
    cands = (j.groupBy("grid_order", layer, "alpha")
             .agg(F.avg(detox.cast("double")).alias("sta"), F.avg(same).alias("sim"), F.count("*").alias("n"))
             .withColumn("score", F.col("sta") + sim_weight * F.col("sim")))
    return cands, top_k(cands, "score", k, ["grid_order"])
