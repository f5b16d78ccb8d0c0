"""Reading customer tables from files and writing marts and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnloom.contract import SEQUENCE, SOURCE_TYPES
from churnloom.errors import IngestionError

FORMATS = ("parquet", "csv", "json", "orc")


def read_customers(spark: SparkSession, path, format: str = "parquet", schema=None,
                   sequence: str | None = SEQUENCE, **options) -> DataFrame:
    """Read a table, trim its headers and stamp the arrival order of every row.

    Arrival order is (file, block, position), which does not change when a task is run
    again. It is computed in the scan, before any shuffle. A CSV is read with the types of the
    contract, unknown columns as text; pass ``inferSchema=True`` to have it read twice instead.
    """
    if format not in FORMATS:
        raise IngestionError(f"unknown format {format!r}, expected one of {FORMATS}")
    reader = spark.read.format(format)
    try:
        if format == "csv":
            options = {"header": True, **options}
            if schema is None and not options.get("inferSchema"):
                schema = _contract_schema(spark.read.options(**options).csv(path).columns)
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.options(**options).load(path)
    except AnalysisException as error:
        raise IngestionError(f"cannot read {path}: {error}") from error
    stamp = []
    if sequence and sequence not in [name.strip() for name in df.columns]:
        position = (F.col("_metadata.row_index") if format == "parquet"
                    else F.monotonically_increasing_id())
        stamp = [F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            position.alias("row")).alias(sequence)]
    df = df.select(*[F.col(f"`{name}`").alias(name.strip()) for name in df.columns], *stamp)
    if df.isEmpty():
        raise IngestionError(f"{path} holds no rows")
    return df


def _contract_schema(names: list[str]) -> T.StructType:
    """Types of the columns of a header; only the header has to be read to know them."""
    kinds = {name: T._parse_datatype_string(kind) for name, kind in SOURCE_TYPES.items()}
    return T.StructType([T.StructField(n, kinds.get(n.strip(), T.StringType())) for n in names])


def source_files(df: DataFrame) -> DataFrame:
    """Name, size and row count of every file behind a table read from files."""
    return (
        df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        .groupBy("path", "bytes").agg(F.count("*").alias("rows")))


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a mart or a report; nested columns are only possible outside CSV."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


def in_order(df: DataFrame, key: str = "CustomerID") -> DataFrame:
    """The rows sorted by customer, each range of customers in a partition: written so, one customer is found by skipping row groups."""
    return df.repartitionByRange(key).sortWithinPartitions(key)


def write_mart(df: DataFrame, path: str, key: str = "CustomerID") -> None:
    """Write a finished mart sorted by customer."""
    write_table(in_order(df, key), path)
