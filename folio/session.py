"""Session settings every operator relies on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings the operators depend on for correct results (not tuning knobs).
REQUIRED_CONF = {
    # all instants are UTC; fixtures and oracles are zone-less UTC
    "spark.sql.session.timeZone": "UTC",
    # JSON metadata rebuilds overlay keys with map_concat: last writer wins
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # INT96 instants carry no statistics that a scan could skip row groups by
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need (idempotent)."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediates.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    file system). Only a local session that leaves it unset gets a scratch
    folder; on a cluster that is an error, since executors would write to
    folders that the driver and the others cannot see.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="folio-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{spark.sparkContext.applicationId}-{next(_COUNTER)}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _counter():
    i = 0
    while True:
        i += 1
        yield i


_COUNTER = _counter()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers: Spark itself hands a zip
    of the sources to every executor (once per application). Only the driver
    reads the zip from its own disk."""
    import os
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_folio_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(), "folio_sources.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.join("folio", os.path.relpath(path, root)))
    context.addPyFile(target)
    context._folio_shipped = True


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the required settings."""
    builder = SparkSession.builder.appName("folio")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.ui.enabled", "false")
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def size_partitions(
    spark: SparkSession,
    input_bytes: int,
    *,
    target_bytes: int = 256 * 1024 * 1024,
    min_partitions: int = 8,
    max_partitions: int = 200_000,
) -> int:
    """Size shuffle and scan partitions for an input of ``input_bytes``.

    The initial shuffle partition count is input / target (clamped); AQE then
    coalesces small partitions towards ``target_bytes`` and splits skewed
    ones, so the count is an upper bound, not a promise. Scan splits are
    capped at the same target so a task's input fits executor memory.
    Returns the shuffle partition count set."""
    import math

    n = max(min_partitions, min(max_partitions, math.ceil(input_bytes / target_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(min(target_bytes, 512 * 1024 * 1024)))
    return n
