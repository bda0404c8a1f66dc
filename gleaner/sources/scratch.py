"""Tables that are written once because several branches of a plan read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (tests, local runs).
LOCAL = "file:///tmp/checkpoints/gleaner-tables"


def folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: ``spark.checkpoint.dir``. A cluster must name one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = LOCAL
    return found if ":" in found.split("/")[0] else f"file://{found}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as written Parquet in the shared folder: a lost executor, or a second reader, costs a read and no work above."""
    path = f"{folder(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
