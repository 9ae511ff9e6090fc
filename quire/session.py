"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "quire") -> SparkSession:
    """Session for tests and the bench. On a cluster the caller's session is used as is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(SCAN_PARTITIONS, str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    """One JVM: its temporary folder is seen by every task (not so with ``local-cluster``)."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when it is unset (tests, local runs) do we pick our own folder, and
    only in local mode: a machine-local folder is never valid on a cluster.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="quire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder, for written tables and sinks."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/quire-{name}-{uuid.uuid4().hex[:12]}"


def plain_path(path: str) -> str | None:
    """A path of the shared folder as Python's ``open`` takes it, or None where the folder is no mounted file system."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None


def stored(df, name: str):
    """Written once to the shared folder and read back: what reads it several times does not run its plan again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SCAN_PARTITIONS = "spark.quire.scanPartitions"


def spread_scan(df, key: str):
    """Deal a scan out over ``spark.quire.scanPartitions`` partitions, where the caller sets it.

    For tables written as few large row groups: such a scan has few tasks. Without the
    setting the scan keeps its splits. Hashed on the id, so a retried task deals alike.
    """
    n = df.sparkSession.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n), key) if n else df


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Rows go to Python in Arrow batches of at most ``most`` bytes, unless the session has a limit of its own.

    With Spark's own limits (64 MB, 10,000 rows) batches grow with a task's part of the table, and a worker
    holds two of them. A longer row stands alone. The setting is read when a plan runs, so it stays.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, most)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable in every Python worker (UDFs, ``mapInPandas``,
    streaming state functions are pickled by module name).

    The package is zipped once per application on the driver and handed to
    ``SparkContext.addPyFile``, which distributes it to the executors. The
    zip is a build artifact for distribution, not data.
    """
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="quire-pkg-")) / "quire.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for f in pkg.rglob("*.py"):
            zf.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(str(out))
    _SHIPPED.add(app)
