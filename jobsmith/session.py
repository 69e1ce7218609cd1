"""Session helpers: a local session for tests/bench and the shared work folder.

On a cluster the session comes from the launcher; the only thing we read from it
is ``spark.checkpoint.dir`` (a shared folder) for staged writes and lineage cuts.
We set our own checkpoint folder only when the session has none (local tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "jobsmith") -> SparkSession:
    """Local session with AQE on and the UI off (tests and bench only)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # pages are large rows: Arrow batches are bounded by bytes, not by a row count
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "32m")
        .config("spark.sql.execution.pythonUDF.arrow.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``jobsmith`` importable in every Python worker (local daemons or cluster
    executors) by shipping it once per application with ``addPyFile``."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # no SparkContext handle: the package must be installed on the workers
        return
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, zpath = tempfile.mkstemp(prefix="jobsmith-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    A folder of our own is made only for a local master (tests); with any other master a
    missing setting is an error, because executors would write to their own disks.
    """
    try:
        cur = spark.sparkContext.getCheckpointDir()
        master = spark.sparkContext.master
    except Exception:  # no SparkContext handle (e.g. a remote session): use the conf only
        cur, master = None, None
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if master is None or not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set (master {master}); set it to a folder all executors share")
        conf = tempfile.mkdtemp(prefix="jobsmith-ckpt-")
    try:
        spark.sparkContext.setCheckpointDir(conf)
        return spark.sparkContext.getCheckpointDir() or conf
    except Exception:
        if master is not None:
            raise
        return conf  # a remote session: the folder is the cluster's own


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for staged tables/files."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/work/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Reliable lineage cut: write the frame once as a table in the shared checkpoint
    folder and read it back (one computation; survives executor loss; never local)."""
    path = work_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._staged_at = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Deletes the tables that ``cut_lineage`` has written for these frames; nothing may read them any more.

    For loops that stage a table a round: the shared folder then holds the last round only."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            sc = df.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
