"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, below ``spark.checkpoint.dir``; where that is unset and all runs on one machine, a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tendon-tables-")
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Below the largest integer, Spark measures a batch for Python after each of its rows.
BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def saved(df: DataFrame, name: str, by_rows: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    With ``by_rows`` the batches that go to Python meanwhile are bounded by their number of rows alone, for small rows; then
    the session's setting is as it was.
    """
    spark = df.sparkSession
    at, before = new_folder(spark, name), spark.conf.get(BYTES_PER_BATCH, None)
    try:
        if by_rows:
            spark.conf.set(BYTES_PER_BATCH, str(2**31 - 1))
        df.write.parquet(at)
    finally:
        if by_rows:
            spark.conf.unset(BYTES_PER_BATCH) if before is None else spark.conf.set(BYTES_PER_BATCH, before)
    return spark.read.schema(df.schema).parquet(at)
