"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_noted: dict[str, list[str]] = {}


def build_session(app: str = "tunewright", cpus: str | int = "*") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small local inputs still do much work per row: keep them on all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "16k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a
    cluster a missing setting is an error, never a machine-local folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _local_roots and context.getCheckpointDir():
        # Set by a call instead of the setting.
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        root = tempfile.mkdtemp(prefix="tunewright-")
        context.setCheckpointDir(root)
        _local_roots[context.applicationId] = root
    return _local_roots[context.applicationId]


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, noted for ``forget``."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _noted.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def forget(spark: SparkSession) -> int:
    """Remove everything this application put under the shared folder; returns the number of paths.

    Call it when no result that reads from there is in use any more.
    """
    context = spark.sparkContext
    paths = _noted.pop(context.applicationId, [])
    for path in paths:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives lost executors and lets several branches reuse one
    computed result.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
