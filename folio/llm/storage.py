"""Files in the shared folder and intermediate tables that cut lineage."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from folio.session import scratch_path, ship_package

__all__ = ["Publication", "by_file", "discard", "open_folder", "shared_folder", "ship_package", "stored"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once what reads them is written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._folio_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, as a URI tasks can open."""
    path = scratch_path(spark, name)
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path


def by_file(files: DataFrame, column: str = "file") -> DataFrame:
    """Deal the rows of a manifest out over as many tasks as it has rows. The
    count is fixed, so that small manifest rows are not coalesced into one task."""
    return files.repartition(max(1, files.count()), column)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class Publication:
    """One task's output file: written under an attempt name, moved into place
    when complete. A task that runs again writes the same bytes under the same
    final name, so a lost executor leaves nothing half-written behind."""

    def __init__(self, uri: str, name: str):
        from pyspark import TaskContext

        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        self.fs, base = open_folder(uri)
        self.final = f"{base}/{name}"
        self.temporary = f"{base}/.{name}.attempt-{attempt}"
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def publish(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.final)
