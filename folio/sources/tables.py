"""Load the driver's parquet tables.

Timestamps arrive as TIMESTAMP_NTZ (zone-less micros). Under a UTC session the
cast to TIMESTAMP is exact; it is applied once here so every operator sees
instants. Column pruning and filter pushdown still reach the scan because the
cast sits in a Project directly above it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from folio.session import configure

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _load_table(spark, sf_dir, name)


def _read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampNTZType)]
    if not ntz:
        return df
    return df.select(
        *[F.col(c).cast("timestamp").alias(c) if c in ntz else F.col(c) for c in df.columns]
    )


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = 64) -> DataFrame:
    """The same table as a file stream (schema taken from the files once;
    timestamps cast to instants as in ``load_table``). ``max_files_per_trigger``
    bounds a micro-batch."""
    configure(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    # the file source wants a folder or a glob; the driver's tables are
    # single files, so a one-file glob names the table
    df = reader.parquet(path[:-1] + "[" + path[-1] + "]")
    ntz = [f.name for f in schema.fields if isinstance(f.dataType, TimestampNTZType)]
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in ntz else F.col(c) for c in df.columns])


_PLANS: dict = {}
#: Plans remembered; the oldest goes first.
MAX_PLANS = 256


def forget_plans() -> None:
    """Forget all plans, so that the next reads list the files anew."""
    _PLANS.clear()


def per_session(fn):
    """Build a derived relation once per (session, table folder).

    Only the lazy DataFrame — the logical plan — is reused; nothing is
    cached or materialised, so every query still reads and computes its
    inputs in full. It saves re-issuing the hundreds of column-building
    calls a derivation makes from Python."""
    import functools

    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str, *args):
        configure(spark)
        key = (fn.__module__, fn.__qualname__, id(spark), sf_dir.rstrip("/"), args)
        hit = _PLANS.get(key)
        if hit is None or hit[0] is not spark:
            hit = (spark, fn(spark, sf_dir, *args))
            while len(_PLANS) >= MAX_PLANS:
                _PLANS.pop(next(iter(_PLANS)))
            _PLANS[key] = hit
        return hit[1]

    return wrapper


_load_table = per_session(_read_table)
