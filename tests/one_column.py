"""Helper of the column tests, under a name that no conftest shares."""


def one_col(spark, values, expr_fn, schema="t string"):
    """Evaluate a column expression over single-column rows, in input order."""
    from pyspark.sql import functions as F
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    out = df.select("i", expr_fn(F.col(schema.split()[0])).alias("o")).orderBy("i").collect()
    return [r["o"] for r in out]
