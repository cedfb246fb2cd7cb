"""Row numbers over whole tables, without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PART = "_part"
ROW_BITS = 33  # fixed value: monotonically_increasing_id keeps the row in its low 33 bits


def global_positions(df: DataFrame, order_by: list[str], name: str = "position",
                     partitions: int | None = None, keep_part: bool = False) -> DataFrame:
    """0-based position of every row in the order ``order_by`` (which must be total).

    A range shuffle puts the rows in order across partitions, equally filled however
    the values are distributed; the sorted rows are checkpointed so that the partition
    number stays what it was, and each partition is shifted by the size of those
    before it. The only window runs over one row per partition.
    """
    spark = df.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = F.monotonically_increasing_id()
    placed = cut_lineage(
        df.repartitionByRange(partitions, *order_by).sortWithinPartitions(*order_by).withColumn("_tag", tag)
    )
    part = F.shiftright(F.col("_tag"), ROW_BITS)
    row = F.col("_tag").bitwiseAND((1 << ROW_BITS) - 1)
    sizes = placed.groupBy(part.alias(PART)).agg(F.count("*").alias("_size"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(PART, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    numbered = (
        placed.withColumn(PART, part)
        .join(F.broadcast(shifts), PART)  # one row per partition
        .withColumn(name, F.col("_shift") + row)
        .drop("_tag", "_shift")
    )
    return numbered if keep_part else numbered.drop(PART)


def keyed_positions(df: DataFrame, key: str, order_by: list[str], name: str = "position") -> DataFrame:
    """0-based position of every row within its key; a key may hold any share of the rows.

    ``order_by`` must be total within the key. Rows are numbered globally in the order
    (key, order_by), and the first number of the key is taken off. That number comes back
    by a join on (range partition, key), so a hot key meets it piece by piece.
    """
    placed = global_positions(df, [key, *order_by], "_at", keep_part=True)
    pieces = placed.groupBy(PART, key).agg(F.min("_at").alias("_lo"))
    first = pieces.select(F.col(PART).alias("_piece"), F.col(key).alias("_of"),
                          F.min("_lo").over(Window.partitionBy(key)).alias("_first"))
    return (
        # rows without a key are a key of their own
        placed.join(first, (F.col(PART) == F.col("_piece")) & F.col(key).eqNullSafe(F.col("_of")))
        .withColumn(name, F.col("_at") - F.col("_first"))
        .drop("_at", "_first", "_piece", "_of", PART)
    )
