"""Spark session and shared-folder helpers.

Everything heavy runs through one SparkSession.  The settings below are the
ones every job relies on: UTC session time (timestamps compare with other
engines), adaptive execution with skew handling, and small Arrow batches for the
one Python-worker job (a single source file may be close to 1 MB).
"""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    BATCH_ROWS: "500",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "revspark",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a context: workers started elsewhere can then import it."""
    sc = spark.sparkContext
    if getattr(sc, "_revspark_shipped", False):
        return
    home = Path(__file__).resolve().parent
    if home.suffix != ".zip" and home.is_dir():
        target = Path(tempfile.mkdtemp(prefix="revspark-pkg-")) / "revspark.zip"  # Spark serves it from the driver
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, Path("revspark") / f.relative_to(home))
        sc.addPyFile(str(target))
    sc._revspark_shipped = True


def ensure_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a distributed file system);
    we only read it.  When it is unset (local tests) we pick a fresh folder and
    register it, so ``DataFrame.checkpoint()`` and streaming checkpoints work.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master or ""
        if not re.fullmatch(r"local(\[.*\])?", master):
            # a machine-local folder is not visible to other executors
            raise RuntimeError("spark.checkpoint.dir is not set: point it at a shared folder "
                               "(distributed file system) before running revspark jobs")
        root = tempfile.mkdtemp(prefix="revspark-ckpt-")
    try:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(root)
    except Exception:  # pragma: no cover - Spark Connect has no sparkContext
        pass
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint root."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def write_once(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new shared folder and read it back, so that nothing that reads it computes it again: what runs
    user code or a Python parse runs once, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = int(DEFAULT_CONF[BATCH_ROWS])):
    """Jobs run inside hand Python at most ``rows`` rows at a time, whatever the session's own limit: a worker, and the
    child that it forks, then hold a few texts each instead of thousands."""
    before = spark.conf.get(BATCH_ROWS)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def local_fs_path(path: str) -> str:
    """Strip a ``file:`` scheme (for os-level checks in tests only)."""
    return path[5:] if path.startswith("file:") else path


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
