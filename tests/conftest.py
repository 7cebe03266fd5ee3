import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from folio.session import REQUIRED_CONF, configure

    builder = (
        SparkSession.builder.master("local[4]")
        .appName("folio-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="folio-test-ckpt-"))
    )
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s
    s.stop()


def one_col(spark, values, name="x", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


def evaluate(spark, column_fn, values, dtype="string"):
    """Apply a Column function to each input value; return outputs in order."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    rows = df.select("i", column_fn(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]
