"""Writers. Each one is a single parallel job; no rows pass through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Text with a header line and no row number column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_lines(df: DataFrame, value: Column, path: str, mode: str = "overwrite") -> None:
    """One value per line."""
    df.select(value.cast("string").alias("value")).write.mode(mode).text(path)


def materialize(df: DataFrame, path: str, table: str | None = None, partition_by: tuple = ()) -> DataFrame:
    """Write the rows (replacing what was there) and return the stored table."""
    writer = df.write.mode("overwrite").format("parquet").partitionBy(*partition_by)
    if table:
        writer.option("path", path).saveAsTable(table)
        return df.sparkSession.table(table)
    writer.save(path)
    return df.sparkSession.read.parquet(path)


def append_to(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Add rows to a stored table, in the column order and types of ``schema``."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    df.write.mode("append").parquet(path)


def typed_empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows."""
    return spark.createDataFrame([], schema)
