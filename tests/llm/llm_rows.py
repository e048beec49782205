"""Rows that the tests share."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000


def documents(spark, texts, start=0, extra=""):
    """Rows of documents; a text may be given as (doc_id, text)."""
    rows = []
    for i, t in enumerate(texts):
        d, t = t if isinstance(t, tuple) else (start + i, t)
        rows.append((d, t, "en" if i % 2 else None, f"src{i % 3}" if i % 4 else None, None if t is None else len(t)))
    df = spark.createDataFrame(rows, SCHEMA)
    for c in extra.split():
        from pyspark.sql import functions as F
        df = df.withColumn(c, F.lit("x"))
    return df


#: Nulls, empty, blank, very long, repeated rows, one id for two texts, control characters.
ODD = [(None, "a null id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same row"), (5, "same row"),
       (6, "one id"), (6, "another text"), (7, "\x00\x1c​ zero \U0001d518 \x85"), (8, LONG + "end"), (9, "word")]
#: Column names that the operators use inside.
CLASH = "_id _gone _twice _row _size _text _source epoch block rows node root k1 deal piece start length h bucket held_out score"
