"""Bucketed caches: lookups without a shuffle of the cache, compaction, stages and replays."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from textguard.operators import gate as G
from textguard.operators.caches import BucketedCache, cached_stages
from textguard.streaming.stream import run_pivot_stream


@pytest.fixture
def cache(spark):
    made = []

    def make(buckets=4):
        c = BucketedCache(spark, f"cache_{uuid.uuid4().hex[:10]}", buckets)
        made.append(c)
        return c
    yield make
    for c in made:
        c.drop()


def entries(spark, rows):
    return spark.createDataFrame(rows, "key string, value string")


def test_append_keeps_one_entry_per_key(spark, cache):
    c = cache()
    assert c.read() is None and not c.exists()
    c.append(entries(spark, [("a", "1"), ("b", None), ("a", "0"), (None, "x")]))
    c.append(entries(spark, [("a", "9"), ("c", "3")]))
    c.append(entries(spark, [("c", "3")]))
    want = [("a", "0"), ("b", None), ("c", "3")]
    assert sorted(map(tuple, c.read().collect())) == want
    c.compact()
    assert sorted(map(tuple, c.read().collect())) == want


def test_compaction_leaves_one_file_per_bucket(spark, cache):
    c = cache(2)
    for i in range(5):
        c.append(entries(spark, [(f"k{i}-{j}", str(j)) for j in range(20)]))
    before = len(c.read().inputFiles())
    c.compact()
    assert before == 10 and len(c.read().inputFiles()) == 2 and c.read().count() == 100


def test_a_lookup_does_not_shuffle_the_cache(spark, cache):
    c = cache(8)
    c.append(entries(spark, [(f"k{i}", str(i)) for i in range(200)]))
    c.compact()
    asked = spark.range(300).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    found = asked.distinct().join(c.read(), "key", "left")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2 and "CartesianProduct" not in plan
    tail = plan[plan.index(c.name) - 3000 if plan.index(c.name) > 3000 else 0:]
    scan = [line for line in plan.splitlines() if c.name in line or "Bucketed: true" in line]
    assert scan and "Bucketed: true" in tail
    # from the join down to the scan of the cache there is no exchange
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and c.name in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, low = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < low:
            above.append(line)
            low = depth(line)
    below_join = above[:next(i for i, line in enumerate(above) if "Join" in line)]
    assert not any("Exchange" in line for line in below_join), below_join
    assert {r.key: r.value for r in found.collect()} == {f"k{i}": str(i) if i < 200 else None for i in range(300)}


def counting(log, change):
    def factory():
        def run(xs):
            with open(log, "a") as f:
                f.writelines(x + "\n" for x in xs)
            return [change(x) for x in xs]
        return run
    return factory


def seen(log):
    try:
        return sorted(open(log).read().split("\n")[:-1])
    except FileNotFoundError:
        return []


def test_each_stage_sees_a_distinct_text_once(spark, cache, tmp_path):
    logs = [str(tmp_path / n) for n in ("forward", "back")]
    stages = [("forward", counting(logs[0], str.upper)), ("back", counting(logs[1], lambda x: x + "!"))]
    caches = {"forward": cache(), "back": cache()}
    df = spark.createDataFrame([(i, f"T{i % 4}" if i % 8 < 4 else f"t{i % 4}") for i in range(24)] + [(90, None), (91, "")], "k int, t string")
    gate = F.coalesce(~F.col("t").endswith("3"), F.lit(True))
    for _ in range(2):
        rows = cached_stages(df, gate, "t", "o", stages, caches).collect()
        assert {(r.t, r.o) for r in rows} == {(f"{c}{i}", f"T{i}!") for c in "Tt" for i in range(3)} | {("T3", "T3"), ("t3", "t3"), (None, None), ("", "!")}
        assert len(rows) == 26
    assert seen(logs[0]) == sorted([f"{c}{i}" for c in "Tt" for i in range(3)] + [""])  # once each, over both runs
    assert seen(logs[1]) == ["", "T0", "T1", "T2"]


def test_a_replayed_batch_adds_no_entry(spark, cache, tmp_path):
    log = str(tmp_path / "calls")
    caches = {"up": cache()}
    src = str(tmp_path / "src")
    spark.range(40).select(F.col("id"), F.concat(F.lit("t"), (F.col("id") % 10).cast("string")).alias("t")).repartition(4).write.parquet(src)
    for base in ("a", "b"):  # the same files again under a lost checkpoint
        stream = spark.readStream.schema("id long, t string").option("maxFilesPerTrigger", 1).parquet(src)
        out = run_pivot_stream(spark, stream, F.col("id") >= 0, "t", "o", [("up", counting(log, str.upper))], caches, str(tmp_path / base))
        assert sorted((r.id, r.o) for r in out.collect()) == [(i, f"T{i % 10}") for i in range(40)]
    assert caches["up"].read().count() == 10 and seen(log) == sorted(f"t{i}" for i in range(10))


def test_python_gets_the_text_column_alone(spark):
    df = spark.createDataFrame([(1, "a", "wide", True), (2, None, "wide", True), (3, "c", "wide", False)], "k int, t string, other string, g boolean")
    for out in (G.gated_edit(df, F.col("g"), "t", "o", batch_editor=lambda: lambda xs: [x.upper() for x in xs]),
                G.batch_map(df, lambda: lambda xs: [None if x is None else x.upper() for x in xs], "t", "o")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        call = re.search(r"ArrowEvalPython \[([^\]]*)\]", plan)[1]
        assert "other" not in call and "k#" not in call and "MapInPandas" not in plan
        assert out.where("k = 2").first().o is None and out.count() == 3
