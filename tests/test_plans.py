"""Plan lint over every registered query: no cross products, few shuffles, and a hot key
(copies of one text) still gives whole, correct results."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


PYTHON = re.compile(r"MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|InPandas|InArrow")
#: Queries whose last job may run a caller's Python model.
MODELS = ("m2_", "m3_", "m4_", "m5_")


#: Shuffles of a query's last job, and of the few that join several scored or positioned tables.
SHUFFLES = 4
MORE = {"e4_sampled_dev": 12, "m1_held_out": 8, "u2_contiguous_split": 8, "j2_align_positional": 6}


def test_no_cross_products_and_python_for_models_alone(spark):
    bad = {}
    for name, fn in E.queries().items():
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        hits = [f for f in FORBIDDEN if f in plan]
        if not name.startswith(("op", "pipeline")):
            shuffles = len(re.findall(r"Exchange (?:hash|range|Round|Single)", plan))
            hits += [f"{shuffles} shuffles"] * (shuffles > MORE.get(name, SHUFFLES))
            stages = len(PYTHON.findall(plan))
            hits += [f"{stages} Python stages"] * (stages > name.startswith(MODELS))
        if hits:
            bad[name] = hits
    assert not bad, bad


def test_grouped_best_of_n_aggregates_no_text(spark):
    plan = E.queries()["o6_best_of_n_grouped"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate(" in line]
    assert aggregates and not any(re.search(r"\b(gen|text|best)#", line) for line in aggregates)


def test_hot_key_cache_and_best_of_n(spark):
    from textguard.operators.gate import with_cache
    from textguard.operators.select import best_of_n_grouped
    n = 3000
    # one text makes up most rows: a hot content key
    df = spark.range(n).select(F.col("id").alias("k"),
                               F.when(F.col("id") % 10 < 7, F.lit("same text"))
                               .otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    res, fresh = with_cache(df, None, "text", "out", lambda m: m.withColumn("value", F.upper("text")))
    assert res.count() == n
    assert res.where(F.col("out") != F.upper("text")).count() == 0
    assert fresh.count() == df.select("text").distinct().count()
    # one key with many attempts
    cands = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("attempt"),
                                  F.concat(F.lit("good day number "), F.col("id").cast("string")).alias("gen"),
                                  F.lit("good day number 7").alias("src"))
    out = best_of_n_grouped(cands, "k", "attempt", "gen", "src", ["bad"]).collect()
    assert len(out) == 1 and out[0]["best"] == "good day number 0"
