"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame

from ..session import scratch_path

_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write the rows below ``spark.checkpoint.dir`` and read them back.

    Cuts the lineage like a checkpoint, in Parquet: the rows survive the loss of any executor, are computed once,
    and can be scanned by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by ``written`` that nothing reads any more, through the file system they lie in."""
    for table in tables:
        path = _paths.pop(table, None) if table is not None else None
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
