"""Readers and writers.

TSV follows two conventions: *raw* (quotes are data, no escaping; what the
comment tables use) and *quoted* (RFC-4180 style: embedded tabs, quotes and
newlines survive a round trip). Writers never trim fields (Spark's CSV
writer trims by default) and write directories, one part per task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import require_columns
from ..session import _path, broadcast_if_small, materialize

# The rewrite table layout.
REWRITE_COLUMNS = ("ID", "tat_toxic", "tat_detox1")


def read_tsv(spark: SparkSession, path, required: Sequence[str] = (), quoted: bool = False,
             schema: str | None = None, drop_malformed: bool = False, malformed_col: str | None = None, header: bool = True) -> DataFrame:
    """S1 (raw) / S2 (quoted). All columns are strings unless ``schema`` is
    given; required columns are checked (P7). With a schema, rows whose field
    count does not fit (P8) are kept with what fits; ``malformed_col`` (part of
    the schema, a string) then holds the line of each, null on good rows, so
    they can be counted; ``drop_malformed`` drops them instead."""
    r = (spark.read.option("sep", "\t").option("header", header)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if quoted:
        r = r.option("quote", '"').option("escape", '"').option("multiLine", True)
    else:
        r = r.option("quote", "").option("escape", "")
    if schema:
        r = r.schema(schema)
    if malformed_col:
        r = r.option("columnNameOfCorruptRecord", malformed_col)
    if drop_malformed:
        r = r.option("mode", "DROPMALFORMED")
    df = r.csv(path)
    return require_columns(df, required)


#: Rows of a quoted file at most: a file with line breaks inside fields is read by one task.
FILE_ROWS = 100_000


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: str | None = None, file_rows: int = FILE_ROWS) -> None:
    """Quoted TSV directory that :func:`read_tsv` (quoted=True) reads back;
    ``partition_by``: one folder per value, all in one pass. A file ends after
    ``file_rows`` rows, so that a reader has as many tasks as the table needs."""
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    (writer.mode(mode).option("sep", "\t").option("header", True).option("maxRecordsPerFile", file_rows)
     .option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_raw_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Raw TSV (the S1 convention: no quoting, quotes are data), a header in
    every part file (the reader drops it per file). A field holding a tab or
    a line break cannot be written raw; the job fails on it (``raise_error``)
    instead of corrupting the file."""
    checked = []
    for c in df.columns:
        v = F.col(c).cast("string")
        checked.append(F.when(F.coalesce(v.rlike("[\t\r\n]"), F.lit(False)),
                              F.raise_error(F.lit(f"raw TSV field {c} holds a tab or line break")))
                       .otherwise(v).alias(c))
    (df.select(*checked).write.mode(mode).option("sep", "\t").option("header", True)
     .option("quote", "").option("escape", "").option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_rewrites(df: DataFrame, path: str, id_col: str = "ID", source: str = "tat_toxic",
                   rewrite: str = "tat_detox1", mode: str = "overwrite") -> None:
    """K1: exactly ``ID, tat_toxic, tat_detox1`` (id as string), header, tab."""
    out = df.select(F.col(id_col).cast("string").alias(REWRITE_COLUMNS[0]),
                    F.col(source).alias(REWRITE_COLUMNS[1]), F.col(rewrite).alias(REWRITE_COLUMNS[2]))
    write_tsv(out, path, mode)


def read_labelled(df: DataFrame, text_candidates: Sequence[str] = ("text", "sentence"),
                  label_candidates: Sequence[str] = ("toxic", "label"),
                  lang: str | None = None, lang_col: str = "lang") -> DataFrame:
    """S3 (+P4): pick the first existing text and label columns, rename them
    to ``text``/``label``, and filter on ``lang`` when asked."""
    tcol = next((c for c in text_candidates if c in df.columns), None)
    if tcol is None:
        raise ValueError(f"no text column among {list(text_candidates)}")
    lcol = next((c for c in label_candidates if c in df.columns), None)
    if lang is not None and lang_col in df.columns:
        df = df.where(F.col(lang_col) == lang)
    keep = [c for c in df.columns if c not in (tcol, lcol)]
    cols = [*keep, F.col(tcol).alias("text")]
    if lcol is not None:
        cols.append(F.col(lcol).cast("int").alias("label"))
    return df.select(*cols)


def read_split_corpus(spark: SparkSession, root: str, split_col: str = "lang", lang: str | None = None,
                      text_candidates: Sequence[str] = ("text", "sentence"), label_candidates: Sequence[str] = ("toxic", "label"),
                      fmt: str = "parquet") -> DataFrame:
    """S3 where the language is a split key: a folder per language below
    ``root``, named ``<split_col>=<value>`` or by the value alone. The folders
    become the column ``split_col``; with ``lang`` (P4) the other folders are not
    read."""
    names = _folders(spark, root)
    if any(n.startswith(f"{split_col}=") for n in names):
        df = spark.read.format(fmt).load(root)
        df = df.withColumn(split_col, F.col(split_col).cast("string"))
    else:
        names = [n for n in names if not n.startswith(("_", ".")) and lang in (None, n)]
        if not names:
            raise FileNotFoundError(f"no folder {lang or ''} below {root}")
        df = None
        for n in names:
            part = spark.read.format(fmt).load(f"{root}/{n}").withColumn(split_col, F.lit(n))
            df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    return read_labelled(df, text_candidates, label_candidates, lang, split_col)


def _folders(spark: SparkSession, root: str) -> list[str]:
    p, fs = _path(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


def read_line_cache(spark: SparkSession, path: str, key: str = "_pos") -> DataFrame:
    """One value per line, with its 0-based line number (line order is
    the meaning, so the position is made explicit).

    Lines are counted per split of each file; a line's number is its place in
    the split plus the lines of the splits before it. No line is shuffled,
    sorted or written."""
    raw = spark.read.text(path).select("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_m"), "value")
    per = materialize(raw.groupBy("file_name", "file_block_start").agg(F.count("*").alias("_n"), F.min("_m").alias("_first")), "line-counts")
    # parts by number (part-99999 before part-100000), splits by their place in the file
    number = F.coalesce(F.regexp_extract("file_name", r"part-(\d+)", 1).try_cast("long"), F.lit(0))
    before = Window.orderBy(number, "file_name", "file_block_start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    per = materialize(per.select("file_name", "file_block_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")), "line-offsets")
    rows = raw.join(broadcast_if_small(per), ["file_name", "file_block_start"], "left")
    place = F.when(F.col("_off").isNull(), F.raise_error(F.lit("a split has changed since its lines were counted")).cast("long")).otherwise(F.col("_m") - F.col("_first") + F.col("_off"))
    return rows.select(place.alias(key), "value")


def write_cache(df: DataFrame, path: str, key: str = "key", value: str = "value",
                stage: str | None = None, mode: str = "append") -> None:
    """K4: keyed cache (Parquet; a newline in a value cannot shift rows),
    optionally partitioned by stage."""
    out = df.select(F.col(key).alias("key"), F.col(value).alias("value"))
    if stage:
        out = out.withColumn("stage", F.lit(stage))
        out.write.mode(mode).partitionBy("stage").parquet(path)
    else:
        out.write.mode(mode).parquet(path)


def read_cache(spark: SparkSession, path: str, stage: str | None = None) -> DataFrame | None:
    if not _exists(spark, path):
        return None
    df = spark.read.parquet(path)
    if stage and "stage" in df.columns:
        df = df.where(F.col("stage") == stage)
    return df.select("key", "value")


def read_parts(spark: SparkSession, paths: Sequence[str], fmt: str = "tsv", quoted: bool = True,
               part_col: str | None = "part") -> DataFrame:
    """Read all parts and stack them in part order (a part number column
    keeps that order explicit); a single path reads as one. A missing part
    raises: a stack without it would be short without a word."""
    from ..operators.sampling import union_parts
    missing = [p for p in paths if not _exists(spark, p)]
    if missing or not paths:
        raise FileNotFoundError(f"missing parts: {missing}")
    return union_parts([read_tsv(spark, p, quoted=quoted) if fmt == "tsv" else spark.read.parquet(p) for p in paths], part_col)


def write_results(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """K2: per-row evaluation / preview / round-trip tables."""
    if fmt == "csv":
        (df.write.mode(mode).option("header", True).option("maxRecordsPerFile", FILE_ROWS).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        df.write.mode(mode).parquet(path)


def write_metrics_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: a metrics frame as JSON lines, as many files as it has partitions;
    NaN is kept as NaN."""
    df.write.mode(mode).json(path)


def metrics_to_json(df: DataFrame) -> str:
    """K3 for a one-row frame: the JSON text (bounded: the frame has one row)."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("metrics frame must have exactly one row")
    return json.dumps(rows[0].asDict(recursive=True), ensure_ascii=False)


VECTOR_BUNDLE_SCHEMA = ("vector array<float>, meta struct<model_id:string, layer_idx:int, "
                        "n_toxic:int, n_nontoxic:int, max_length:int>")


def write_vector_bundle(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K5: rows of ``vector`` + ``meta`` as Parquet."""
    df.select(F.col("vector").cast("array<float>"), "meta").write.mode(mode).parquet(path)


def read_vector_bundle(spark: SparkSession, path: str, default_layer: int) -> DataFrame:
    """The stored vector with its layer (``default_layer`` when the meta
    has none)."""
    df = spark.read.parquet(path)
    layer = F.coalesce(F.col("meta.layer_idx"), F.lit(default_layer)) if "meta" in df.columns \
        else F.lit(default_layer)
    return df.select("vector", layer.alias("layer"), *(["meta"] if "meta" in df.columns else []))


def load_or_build(spark: SparkSession, path: str, build, default_layer: int) -> DataFrame:
    """Read the stored bundle if it is complete (the writer's success
    marker is there), else compute it with ``build()`` (a DataFrame of the
    bundle layout), save it over what is there, and read it back."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        bundle = build()
        if bundle is None:
            raise FileNotFoundError(f"{path} missing and nothing to build it from")
        write_vector_bundle(bundle, path)
    return read_vector_bundle(spark, path, default_layer)


def _exists(spark: SparkSession, path: str) -> bool:
    """Path existence through Hadoop's FileSystem (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))

