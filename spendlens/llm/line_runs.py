"""Line dedup with levelled sorted runs of line hashes.

Documents are taken in batches of descending id. A batch's line keys are merge-anti-joined with the
runs written so far: a key that no run holds is new, and the batch's largest document becomes its
holder; a key some run holds only adds to its count. The batch then adds its own sorted run. When a
level has ``fan_in`` runs they are merged into one run of the next level, so a batch meets few runs.
After the last batch the runs are merged once more; keys found in enough documents lose their lines
everywhere except in their holder, the largest document.

Only hashes and counts are shuffled and written, never the lines. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

BLANKS = " \t\n\x0b\x0c\r"
CUT_SAMPLE = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column, min_chars: int) -> Column:
    """Per line: 128-bit digest of its key, null where the key is too short."""
    def one(line):
        key = line_key(line)
        return F.when(F.length(key) >= min_chars, F.unhex(F.md5(key)))

    return F.transform(_lines(text), one)


def _merged(runs: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, runs)
    return every.groupBy("h").agg(F.sum("docs").alias("docs"), F.max("holder").alias("holder"))


def _cuts(rows: DataFrame, batches: int) -> list:
    """Keys that cut the table into about equal batches, largest first; keys of any type that has an order.

    They come from the ``CUT_SAMPLE`` keys of least hash: one bounded heap per task, the same in every run."""
    drawn = rows.select("_key").filter(F.col("_key").isNotNull()).orderBy(F.xxhash64("_key"), "_key").limit(CUT_SAMPLE)
    keys = [r[0] for r in drawn.orderBy("_key").collect()] if batches > 1 else []
    return sorted({keys[len(keys) * i // batches] for i in range(1, batches)} if keys else set(), reverse=True)


class LevelledRuns:
    """Sorted runs of (line hash, documents, holder) in the shared folder, compacted by level.

    ``holder`` is set in the one run in which the hash was new."""

    def __init__(self, fan_in: int = 2):
        self.fan_in, self.levels = fan_in, []

    def _write(self, rows: DataFrame) -> DataFrame:
        return written(rows.repartition("h").sortWithinPartitions("h"), "line-run")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h, docs, last), one row per line hash of the batch."""
        own = batch.withColumnRenamed("last", "holder")
        if known := self.runs():
            # a hash has its holder in one run at most, so this join neither drops nor repeats a row of the batch
            seen = reduce(DataFrame.unionByName, [run.filter("holder is not null").select(F.col("h").alias("_seen")) for run in known])
            own = own.hint("merge").join(seen, F.col("h") == F.col("_seen"), "left").select(
                "h", "docs", F.when(F.col("_seen").isNull(), F.col("holder")).alias("holder"))
        run, level = self._write(own), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fan_in:
                return
            run = self._write(_merged(self.levels[level]))
            discard(*self.levels[level])
            self.levels[level] = []
            level += 1

    def compact(self) -> DataFrame:
        """All runs as one."""
        runs = self.runs()
        self.levels = [[runs[0] if len(runs) == 1 else self._write(_merged(runs))]]
        return self.levels[0][0]


def drop_shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 40,
                      min_docs: int = 5, batches: int = 4, fan_in: int = 2) -> DataFrame:
    """Per document: key, ``n_lines``, ``n_dropped``, ``kept`` (its other lines, joined by line feeds).

    * null or empty text: one empty line, kept
    * rows that share a key, null included, count as one document and each keeps a row of its own; a null key is
      smaller than any other, so it holds a line only if no other document has it
    * lines of any length are read whole; a line that stands several times in its holder keeps all its places
    * an empty table gives no rows; other columns of ``docs`` play no part, whatever their names
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_tag"))
    # where each long line stands; written once, as batches and the last join all read it
    places = written(
        rows.select("_key", "_tag", F.posexplode(_hashes(F.col("_text"), min_chars)).alias("pos", "h")).filter("h is not null"),
        "line-places",
    )
    found = places.select("_key", "h").groupBy("_key", "h").agg(F.lit(1).alias("one"))
    edges = _cuts(rows, batches)
    runs = LevelledRuns(fan_in)
    for i in range(len(edges) + 1):
        part = found
        if i < len(edges):
            part = part.filter(F.col("_key") > edges[i])
        if i > 0:
            below = F.col("_key") <= edges[i - 1]
            part = part.filter(below | F.col("_key").isNull() if i == len(edges) else below)
        runs.add(part.groupBy("h").agg(F.count("*").alias("docs"), F.max("_key").alias("last")))
    shared = runs.compact().filter(F.col("docs") >= min_docs).select("h", "holder")
    lost = (
        places.join(shared, "h")
        .filter(F.col("_key").isNull() & F.col("holder").isNotNull() | (F.col("_key") != F.col("holder")))
        .select(F.col("_key").alias("_of"), F.col("_tag").alias("_same"), "pos")
        .groupBy("_of", "_same").agg(F.collect_set("pos").alias("_lost"))
    )
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    untouched = F.col("_lost").isNull()
    return (
        rows.join(lost, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_tag") == F.col("_same")), "left")
        .withColumn("_lines", _lines(F.col("_text")))
        .select(
            F.col("_key").alias(key),
            F.size("_lines").cast("long").alias("n_lines"),
            F.when(untouched, 0).otherwise(F.size("_lost")).cast("long").alias("n_dropped"),
            F.when(untouched, F.coalesce("_text", F.lit(""))).otherwise(kept).alias("kept"),
        )
    )
