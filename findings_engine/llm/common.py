"""Shared pieces of the training-data operators.

* ``materialize``: cut lineage with a Parquet table in the cluster's shared
  folder (``spark.checkpoint.dir``), so a lost executor costs a re-read and not
  a recomputation, and so statistics of the written table steer later joins.
* ``digest_text``: null-safe text.
* ``map_batches``: Arrow batches through a Python generator, cut to a bounded
  number of rows, so memory doesn't depend on how many rows Spark puts in one.
* ``tasks_for``: how many tasks a shuffle of a table needs, so that tasks stay
  the same size when the table grows.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1024
MAX_TASKS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is named and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark, "_fe_shared_dir", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="fe-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark._fe_shared_dir = own
    return own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fe-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._fe_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again: all that stands on them has been written."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._fe_path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows: a batch of long texts stays small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def digest_text(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def sample_texts(texts: DataFrame, rows: int, chars: int) -> list[str]:
    """Whole texts of ``rows`` distinct rows of (doc_id, text), of those with at most ``chars`` characters.

    Those with the least hashes, so a sample depends on the table alone. The count
    of all rows gives a bound on the hashes that leave their tasks, about 2 * rows;
    at most ``rows`` times ``chars`` characters reach the driver. A table of mostly
    longer texts gives a smaller sample.
    """
    short = texts.where(F.length("text") <= chars).select(F.xxhash64("doc_id", "text").alias("h"), "text")
    bound = min(1 << 32, 2 * rows * (1 << 32) // max(1, texts.count()) + 1)
    few = short.where(F.pmod("h", F.lit(1 << 32)) < bound).groupBy("h").agg(F.first("text").alias("text"))
    return [r.text for r in few.orderBy(F.pmod("h", F.lit(1 << 32)), "h").limit(rows).select("text").collect()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_batches(
    df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], dict], rows: int = 256
) -> DataFrame:
    """``f`` gets slices of up to ``rows`` rows and returns columns by name."""
    small_batches(df.sparkSession)
    arrow = arrow_schema(schema)

    def run(batches):
        for b in pieces(batches, rows):
            out = f(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[x.name], x.type) for x in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(df: DataFrame, size: int = 64 << 20) -> int:
    """Tasks of about ``size`` stored bytes of ``df``, and no fewer than the session's shuffle partitions."""
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wide = -(-stored // size) if stored < 1 << 60 else 0  # Spark's way to say that it doesn't know
    return max(shuffle_width(df.sparkSession), min(wide, MAX_TASKS))
