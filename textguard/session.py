"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs regardless of cluster size. Shuffle partition counts are
# left to AQE (coalescing small partitions, splitting skewed ones) so the same
# plan holds at sf0.01 on a laptop and at 100 TB on a cluster.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key's partition even when that costs an extra shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}

# Broadcast policy: never broadcast on a *static estimate* (a derived table's
# estimate can be far off at 100 TB); AQE may still broadcast a join side once
# its shuffle has run and its *measured* size is under the adaptive threshold.
# Tables that are bounded by construction (one-row aggregates, per-group
# means, parameter grids, per-partition offsets) are broadcast explicitly.
BROADCAST_POLICY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
}


#: Bytes of an Arrow batch: what a Python worker holds of a task's rows at a time, however long the texts are.
ARROW_BATCH_BYTES = 4 << 20


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "textguard", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the base configuration.

    On a cluster ``master`` is left unset so the launcher decides.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    conf.update(BROADCAST_POLICY)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the executors live in the driver JVM
        conf.setdefault("spark.driver.memory", "12g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    prepare(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is. Only when the
    setting is absent and the master is local (tests) a scratch folder is
    created; on any other master that would be a folder of each machine, so
    it raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="textguard-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
    except Exception:  # noqa: BLE001 - sessions without a local SparkContext use the conf only
        pass
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (reliable, survives
    executor loss) and return a frame that reads from it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def ship_package(spark: SparkSession) -> None:
    """Make ``textguard`` importable in executor Python workers (Python
    model stages pickle references to its functions). Zips the package once
    per application and distributes it with ``addPyFile``, like
    ``spark-submit --py-files``. A no-op when it is already shipped."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext: nothing to ship to
        return
    if sc.getConf().get("spark.textguard.shipped", "") == "1" or getattr(sc, "_textguard_shipped", False):
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="textguard-pkg-"), "textguard.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    sc._textguard_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Checkpoint folder, broadcast policy and package distribution: call
    before running jobs on a session built elsewhere."""
    for k, v in BROADCAST_POLICY.items():
        spark.conf.set(k, v)
    for k in ("spark.sql.adaptive.skewJoin.enabled", "spark.sql.adaptive.forceOptimizeSkewedJoin"):
        spark.conf.set(k, "true")
    if spark.conf.get("spark.sql.adaptive.enabled", "true") != "true":
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


#: Spark deletes what an action has shuffled when the action ends (read when it starts).
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Actions that begin inside leave no shuffle files: the disk holds those of
    one at a time. For frames that run once; a frame that is run again after it
    would have to shuffle anew."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts the lineage (a lost executor does not recompute the upstream
    job) and gives the table a measured size."""
    import uuid
    spark = df.sparkSession
    path = os.path.join(_tables(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return with_size(spark.read.parquet(path), folder_bytes(spark, path))


def _tables(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "tables", spark.sparkContext.applicationId)


def _path(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(sc._jsc.hadoopConfiguration())


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files of a folder (one request to the file system)."""
    p, fs = _path(spark, path)
    return int(fs.getContentSummary(p).getLength())


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables this application has stored (call when its results
    are written; frames that still read them fail afterwards)."""
    p, fs = _path(spark, _tables(spark))
    fs.delete(p, True)


def with_size(df: DataFrame, n_bytes: int | None) -> DataFrame:
    """Note on ``df`` that it holds no more than a stored table of ``n_bytes``."""
    df._stored_bytes = n_bytes
    return df


def stored_bytes(df: DataFrame) -> int | None:
    """Bytes that :func:`materialize` wrote for ``df``, None if it was not
    stored (its size is then unknown before running it)."""
    return getattr(df, "_stored_bytes", None)


# Bound for broadcasting a materialised table: its Parquet size times an
# expansion factor (columnar compression vs rows in memory) must stay below
# this many bytes.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
PARQUET_EXPANSION = 5


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast hint only when the table's stored size proves it small;
    otherwise the join stays a (skew-aware, AQE-managed) sort-merge join."""
    from pyspark.sql import functions as F
    n = stored_bytes(df)
    if n is not None and n * PARQUET_EXPANSION <= max_bytes:
        return F.broadcast(df)
    return df
