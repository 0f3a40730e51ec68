"""Tables that later steps read more than once, written where every executor can read them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is named, as in tests on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_findings_dir", None)
    if own is None:
        own = spark._findings_dir = tempfile.mkdtemp(prefix="findings-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the plan, survives a lost executor, and gives later joins a size to go by."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
