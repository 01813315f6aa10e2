"""A folder that all executors share, for what a query writes and reads again."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset, under a new local folder in local mode, as in tests;
    an error on a cluster, whose executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.melodex.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="melodex-")
        spark.conf.set("spark.melodex.scratch", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: its size is known, and nothing before it is computed again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
