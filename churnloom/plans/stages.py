"""Where lineage is cut and how small sides of a join are recognised.

A stage is a parquet table in the shared checkpoint folder. It survives the loss of
executors, its columns can be pruned and filters reach its scan, which is why it is
preferred over a checkpointed RDD for everything that is read more than once.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is held by the driver and broadcast only up to this many rows and bytes.
SMALL_ROWS = 20_000
SMALL_BYTES = 8 << 20
# Spark's setting to remove what a query shuffled as soon as the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a single-machine session may fall back to a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="churnloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder."""
    return f"{shared_folder(spark)}/stages/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries begun inside leave no shuffle files behind; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a stage and return a DataFrame that reads the stage. What was shuffled for it is gone then."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stages: DataFrame) -> None:
    """Remove stages that ``cut`` returned; nothing may read them any more."""
    for df in stages:
        spark = df.sparkSession
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def literal_table(spark: SparkSession, columns: dict[str, list], types: dict[str, str] | None = None):
    """A fixed table from Python lists; becomes a local relation in the plan."""
    df = spark.createDataFrame(pa.table(columns))
    for name, spark_type in (types or {}).items():
        df = df.withColumn(name, F.col(name).cast(spark_type))
    return df


def small(df: DataFrame, name: str) -> DataFrame:
    """Evaluate a parameter table; mark it for broadcast only if it is small.

    At most ``SMALL_ROWS + 1`` rows are fetched to find out. A larger table becomes a stage
    without a mark, so Spark joins it by shuffling (with skew splitting by adaptive
    execution).
    """
    head = df.limit(SMALL_ROWS + 1).toArrow()
    if head.num_rows <= SMALL_ROWS and head.nbytes <= SMALL_BYTES:
        return F.broadcast(df.sparkSession.createDataFrame(head, df.schema))
    return cut(df, name)
