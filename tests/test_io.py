"""Readers and writers: TSV conventions, caches, bundles, parts."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from textguard.sources import io as IO

TRICKY = ['has "quote"', "back\\slash", "tab\there", "new\nline", "  leading blanks", "NA", "plain"]


def test_empty_field_reads_back_as_null(spark):
    df = spark.createDataFrame([("1", "", "x")], "ID string, tat_toxic string, tat_detox1 string")
    path = os.path.join(scratch(), "empty")
    IO.write_rewrites(df, path)
    r = IO.read_tsv(spark, path, quoted=True).first()
    assert r["tat_toxic"] is None and r["tat_detox1"] == "x"


def scratch():
    return tempfile.mkdtemp(prefix="textguard-test-")


def test_quoted_tsv_round_trip(spark):
    rows = [(str(i), t, t.upper()) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "ID string, tat_toxic string, tat_detox1 string")
    path = os.path.join(scratch(), "rw")
    IO.write_rewrites(df, path)
    back = IO.read_tsv(spark, path, required=IO.REWRITE_COLUMNS, quoted=True)
    assert back.columns == list(IO.REWRITE_COLUMNS)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_raw_tsv_keeps_quotes_as_data(spark):
    d = scratch()
    p = os.path.join(d, "raw.tsv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('ID\ttat_toxic\n1\t"quoted" text\n2\tNA\n3\t  spaced\n')
    df = IO.read_tsv(spark, p, required=["ID", "tat_toxic"])
    got = {r["ID"]: r["tat_toxic"] for r in df.collect()}
    assert got == {"1": '"quoted" text', "2": "NA", "3": "  spaced"}
    with pytest.raises(ValueError):
        IO.read_tsv(spark, p, required=["ID", "missing"])


def test_read_labelled_resolves_columns(spark):
    df = spark.createDataFrame([("x", 1, "tt"), ("y", 0, "en")], "sentence string, label int, lang string")
    out = IO.read_labelled(df, lang="tt")
    assert [tuple(r) for r in out.select("text", "label").collect()] == [("x", 1)]
    with pytest.raises(ValueError):
        IO.read_labelled(df.select("label"))


def test_line_cache_positions(spark):
    d = scratch()
    p = os.path.join(d, "cache.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("first\nsecond\n\nfourth\n")
    got = [(r["_pos"], r["value"]) for r in IO.read_line_cache(spark, p).orderBy("_pos").collect()]
    assert got == [(0, "first"), (1, "second"), (2, ""), (3, "fourth")]


def test_line_cache_orders_parts_by_number(spark):
    d = scratch()
    for n, line in ((99999, "first"), (100000, "second"), (7, "zeroth")):
        with open(os.path.join(d, f"part-{n:05d}-x.txt"), "w") as f:
            f.write(line + "\n")
    got = [(r["_pos"], r["value"]) for r in IO.read_line_cache(spark, d).orderBy("_pos").collect()]
    assert got == [(0, "zeroth"), (1, "first"), (2, "second")]


def test_keyed_cache_round_trip(spark):
    d = os.path.join(scratch(), "kc")
    df = spark.createDataFrame([("k1", "line\nwith break"), ("k2", "v2")], "key string, value string")
    IO.write_cache(df, d, stage="fwd")
    IO.write_cache(df.limit(1), d, stage="back")
    assert IO.read_cache(spark, d, "fwd").count() == 2
    assert IO.read_cache(spark, os.path.join(d, "nope")) is None


def test_read_parts_in_order(spark):
    d = scratch()
    a, b = os.path.join(d, "p1"), os.path.join(d, "p2")
    IO.write_tsv(spark.createDataFrame([("1", "a")], "ID string, t string"), a)
    IO.write_tsv(spark.createDataFrame([("2", "b")], "ID string, t string"), b)
    out = IO.read_parts(spark, [a, b])
    assert sorted((r["part"], r["ID"]) for r in out.collect()) == [(0, "1"), (1, "2")]
    with pytest.raises(FileNotFoundError, match="missing"):
        IO.read_parts(spark, [a, os.path.join(d, "missing"), b])


def test_metrics_json(spark):
    df = spark.createDataFrame([(0.5, 0.25, float("nan"))], "sta double, sim double, fl double")
    js = json.loads(IO.metrics_to_json(df))
    assert js["sta"] == 0.5 and js["sim"] == 0.25
    p = os.path.join(scratch(), "m")
    IO.write_metrics_json(df, p)
    assert spark.read.json(p).count() == 1


def test_vector_bundle_load_or_build(spark):
    p = os.path.join(scratch(), "bundle")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame(
            [([0.5, -1.0], ("m", None, 3, 4, 128))],
            "vector array<float>, meta struct<model_id:string, layer_idx:int, n_toxic:int, "
            "n_nontoxic:int, max_length:int>")
    a = IO.load_or_build(spark, p, build, default_layer=21).first()
    b = IO.load_or_build(spark, p, build, default_layer=21).first()
    assert calls == [1]
    os.remove(os.path.join(p, "_SUCCESS"))  # a write that did not end
    assert IO.load_or_build(spark, p, build, default_layer=21).count() == 1 and calls == [1, 1]
    assert a["layer"] == 21 and list(a["vector"]) == [0.5, -1.0] and b["layer"] == 21


def test_drop_malformed_rows(spark):
    d = scratch()
    p = os.path.join(d, "bad.tsv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("ID\ttat_toxic\ttat_detox1\n1\ta\tb\n2\tonly-two\n3\tx\ty\textra\n4\tc\td\n")
    df = IO.read_tsv(spark, p, schema="ID string, tat_toxic string, tat_detox1 string", drop_malformed=True)
    assert sorted(r["ID"] for r in df.collect()) == ["1", "4"]


def test_write_results_csv(spark):
    p = os.path.join(scratch(), "eval")
    df = spark.createDataFrame([("a, b", "x\ny", True, 0.5, 0.1)],
                               "text string, generated string, edited boolean, tox_score_before double, "
                               "tox_score_after double")
    IO.write_results(df, p)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .schema(df.schema).csv(p))
    assert [tuple(r) for r in back.collect()] == [("a, b", "x\ny", True, 0.5, 0.1)]


def test_apply_to_columns_and_select_ordered(spark):
    import warnings

    from textguard.functions import text as T
    from textguard.operators.columns import apply_to_columns, select_ordered
    df = spark.createDataFrame([("  a  b ", " c ", 1)], "x string, y string, z int")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        out = apply_to_columns(df, "x, y, missing", T.collapse_ws)
    assert any("missing" in str(m.message) for m in w)
    assert tuple(out.first()) == ("a b", "c", 1)
    sel, reordered = select_ordered(df, ["z", "x"])
    assert sel.columns == ["z", "x"] and reordered


def test_raw_tsv_writer_round_trip_and_refusal(spark):
    p = os.path.join(scratch(), "raw")
    df = spark.createDataFrame([("1", 'say "hi"'), ("2", "  x")], "ID string, tat_toxic string")
    IO.write_raw_tsv(df, p)
    got = {r["ID"]: r["tat_toxic"] for r in IO.read_tsv(spark, p, required=["ID", "tat_toxic"]).collect()}
    assert got == {"1": 'say "hi"', "2": "  x"}
    bad = spark.createDataFrame([("1", "a\tb")], "ID string, tat_toxic string")
    with pytest.raises(Exception):
        IO.write_raw_tsv(bad, os.path.join(scratch(), "bad"))


def test_language_as_a_folder(spark, tmp_path):
    rows = [(1, "a", 1, "en"), (2, "b", 0, "tt"), (3, "c", None, "en"), (4, "d", 1, "07")]
    df = spark.createDataFrame(rows, "id int, sentence string, toxic int, lang string")
    keyed, plain = str(tmp_path / "keyed"), str(tmp_path / "plain")
    df.write.partitionBy("lang").parquet(keyed)
    for lang in ("en", "tt"):
        df.where(F.col("lang") == lang).drop("lang").write.parquet(f"{plain}/{lang}")
    one = IO.read_split_corpus(spark, keyed, lang="en")
    assert sorted(map(tuple, one.select("id", "text", "label", "lang").collect())) == [(1, "a", 1, "en"), (3, "c", None, "en")]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "lang" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.lang for r in IO.read_split_corpus(spark, keyed).collect()} >= {"en", "tt"}
    assert sorted(r.id for r in IO.read_split_corpus(spark, plain, lang="tt").collect()) == [2]
    assert sorted((r.id, r.lang) for r in IO.read_split_corpus(spark, plain).collect()) == [(1, "en"), (2, "tt"), (3, "en")]
    with pytest.raises(FileNotFoundError):
        IO.read_split_corpus(spark, plain, lang="xx")


def test_quoted_files_end_after_some_rows(spark, tmp_path):
    path = str(tmp_path / "tsv")
    IO.write_tsv(spark.range(25).select(F.col("id"), F.lit("two\nlines").alias("t")).coalesce(1), path, file_rows=10)
    back = IO.read_tsv(spark, path, quoted=True)
    assert back.rdd.getNumPartitions() >= 1 and len(back.inputFiles()) == 3 and back.count() == 25
