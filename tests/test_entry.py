"""Driver contract: entry runs, registry and oracles line up, and a sample
of queries agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "labels", "conversations", "embeddings", "benchmark"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["lang", "n_rows", "n_blank_rewrite", "n_blank_source", "avg_len_source", "avg_len_rewrite"]


def test_registry_names_and_oracles():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 50
    for name in q:
        assert name == "pipeline" or name.split("_")[0][0] in "cpgjaomuvske", name


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for _, r in pdf.iterrows()), key=repr)


FAST = ["c4_cleanse", "c9_filter_tokens", "c12_extract_marked_answer", "g1_gated_edit", "m1_nb_score",
        "o2_train_val_split", "u4_dense_id", "v3_diff_in_means", "o6_best_of_n", "m4_pivot_edit",
        "s11_stream_gated_edit"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    sp = E.queries()[name](spark, SF).toPandas()
    dk = con.execute(E.oracle_sql()[name]).df()
    assert _rows(sp) == _rows(dk)


SPARK_TO_DUCK = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT"}


def test_oracle_column_types_match(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    q, s = E.queries(), E.oracle_sql()
    bad = {}
    for name, sql in s.items():
        sch = {f.name: SPARK_TO_DUCK.get(str(f.dataType), str(f.dataType)) for f in q[name](spark, SF).schema.fields}
        rel = con.sql(sql)
        dk = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        if sch != dk:
            bad[name] = (sch, dk)
    assert not bad, bad
