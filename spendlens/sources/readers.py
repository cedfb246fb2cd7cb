"""Readers with known schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import strip_suffix_names
from ..operators.ranks import not_before, tuple_at_rank

FIELD_MARK = "\u0001"  # fixed value: separator of the mart export


def read_cycles(spark: SparkSession, path: str, schema: T.StructType = schemas.CYCLES) -> DataFrame:
    """Cycle table from parquet, or from text whose header line says which column is which.

    Columns of ``schema`` come first, in its order and types; those the files lack are null.
    Further named columns follow as text, columns without a name are dropped. Files of one
    folder must share a header: another one raises an error instead of shifting values.
    """
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    header = spark.read.option("header", True).csv(path).columns  # reads one line
    known = {f.name.lower(): f for f in schema.fields}
    found = T.StructType([
        T.StructField(name, known[name.lower()].dataType if name.lower() in known else T.StringType(), True)
        for name in header
    ])
    rows = spark.read.schema(found).option("header", True).option("enforceSchema", False).csv(path)
    present = {name.lower() for name in header}
    columns = [
        F.col(f"`{f.name}`").alias(f.name) if f.name.lower() in present else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    # an empty name in the header reads as _c and the position
    extra = [name for i, name in enumerate(header) if name.lower() not in known and name != f"_c{i}"]
    return rows.select(*columns, *[F.col(f"`{name}`") for name in extra])


def header_names(spark: SparkSession, header_path: str) -> list[str]:
    """Column names from a side file: line breaks removed, split at commas."""
    text = spark.read.option("wholetext", True).text(header_path).first()[0]
    return [name.strip() for name in text.replace("\r", "").replace("\n", "").split(",")]


def read_delimited(spark: SparkSession, path: str, header_path: str, sep: str = FIELD_MARK) -> DataFrame:
    """Headerless text whose names come from a side file; every column is text."""
    names = header_names(spark, header_path)
    schema = T.StructType([T.StructField(name, T.StringType(), True) for name in names])
    return spark.read.schema(schema).option("sep", sep).csv(path)


def read_mart_export(spark: SparkSession, path: str, header_path: str, suffix: str = "_varchar") -> DataFrame:
    """Mart export with its name suffix removed."""
    return strip_suffix_names(read_delimited(spark, path, header_path), suffix)


def head_rows(df: DataFrame, n: int, order_by: list[str | Column]) -> DataFrame:
    """First ``n`` rows in a stated order (one bounded heap per task, then a merge)."""
    return df.orderBy(*order_by).limit(n)


def row_range(df: DataFrame, lo: int, n: int, order_by: list[str]) -> DataFrame:
    """Rows ``lo .. lo+n-1`` of the table in ascending order (nulls first); ``order_by`` must end in a unique column.

    The rows at both ends are selected by rank, and the range is a filter between them: the table
    is neither sorted nor numbered nor stored, however far inside the range lies.
    """
    first, stop = (tuple_at_rank(df, order_by, at) for at in (lo, lo + n))
    if first is None or n <= 0:
        return df.where(F.lit(False))
    inside = df.where(not_before(order_by, first))
    return inside if stop is None else inside.where(~not_before(order_by, stop))


def schema_table(df: DataFrame) -> DataFrame:
    """Position, name, type and nullability of every column, as a table."""
    rows = [
        (i, f.name, f.dataType.simpleString(), int(f.nullable)) for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "position long, name string, type string, nullable long")
