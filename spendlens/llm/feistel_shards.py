"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Row number -> permuted number -> shard (remainder) and slot (quotient). The permutation is computed
from the seed alone, so anyone who knows seed and row count can tell where a row lies, or, running it
backwards, which row lies in a slot. Shard sizes differ by one row at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round_keys(seed: int) -> list[int]:
    out, x = [], seed & 0xFFFFFFFFFFFFFFFF
    for _ in range(ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) & 0xFFFFFFFFFFFFFFFF
        out.append(x >> 16)
    return out


def _scramble(half: np.ndarray, key: int, bits: int) -> np.ndarray:
    x = (half ^ np.uint64(key & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x = (x + np.uint64(key)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(31)) & np.uint64((1 << bits) - 1)


def _walk(numbers: np.ndarray, n: int, seed: int, keys: list[int], forward: bool) -> np.ndarray:
    bits = _half_bits(n)
    low = np.uint64((1 << bits) - 1)
    out = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):  # cycle walking: the domain has at most four times n values, so few steps
        left, right = out[todo] >> np.uint64(bits), out[todo] & low
        for key in keys:
            if forward:
                left, right = right, left ^ _scramble(right, key, bits)
            else:
                left, right = right ^ _scramble(left, key, bits), left
        out[todo] = (left << np.uint64(bits)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Image of row numbers below n under the seeded permutation of 0 .. n-1."""
    return _walk(numbers, n, seed, _round_keys(seed), True)


def unpermute(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Inverse of ``permute``."""
    return _walk(numbers, n, seed, _round_keys(seed)[::-1], False)


def row_numbers(df: DataFrame, order: list[str], buckets: int = 1 << 16, name: str = "row_number") -> tuple[DataFrame, int]:
    """Global 0-based row numbers that depend on the rows alone, and the row count.

    Rows are dealt by a hash of the ``order`` columns into ``buckets`` buckets and numbered within each in that
    order; a bucket starts where the one before it ends. No sampling and no order of arrival is involved, so a
    recomputed task gives the same numbers. Rows equal in all ``order`` columns get neighbouring numbers. A bucket is
    sorted in one task: 100 TB of rows make buckets of 1.5 GB, while the table of their starts stays at a megabyte."""
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    rows = df.withColumn("_bucket", bucket)
    sizes = sorted(rows.groupBy("_bucket").agg(F.count("*").alias("n")).collect())  # at most ``buckets`` rows
    starts, total = [], 0
    for b, n in sizes:
        starts.append((b, total))
        total += n
    table = spark.createDataFrame(starts, "_at int, _start long").coalesce(1)
    window = Window.partitionBy("_bucket").orderBy(*order)
    numbered = (
        rows.withColumn("_row", F.row_number().over(window).cast("long") - 1)
        .join(F.broadcast(table), F.col("_bucket") == F.col("_at"), "left")  # at most ``buckets`` rows
        .withColumn(name, F.col("_row") + F.col("_start"))
        .drop("_bucket", "_at", "_row", "_start")
    )
    return numbered, total


def shuffle_into_shards(df: DataFrame, order: list[str], shards: int = 8, seed: int = 0) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` and ``slot`` (columns of those names are replaced).

    Shard sizes differ by one at most; slots of a shard count from 0 without a gap. ``order`` should tell rows
    apart: rows equal in it are told apart by nothing and get the places that belong to them in some order, which
    makes no difference where whole rows are equal. Nulls and empty texts order like any value. An empty table
    gives no rows."""
    numbered, n = row_numbers(df.drop("shard", "slot"), order, name="_number")

    @pandas_udf("long")
    def image(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    placed = numbered.withColumn("_image", image("_number"))
    return placed.withColumn("shard", F.pmod("_image", F.lit(shards)).cast("int")) \
        .withColumn("slot", F.floor(F.col("_image") / shards).cast("long")).drop("_number", "_image")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Placement of every document without its text: key, ``size``, ``text_crc32``, ``shard``, ``slot``.

    A null text has size 1 and the checksum of an empty one. Null keys are keys like any other; repeated rows get
    places of their own. Other columns of ``docs`` play no part, whatever their names."""
    content = F.coalesce(F.col(text), F.lit("")).cast("string")
    rows = docs.select(F.col(key), (F.octet_length(content) + 1).cast("long").alias("size"),
                       F.crc32(content.cast("binary")).alias("text_crc32"))
    order = [key, "text_crc32", "size"]
    return shuffle_into_shards(rows, order, shards, seed)
