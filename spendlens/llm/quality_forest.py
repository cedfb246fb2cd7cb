"""Quality rules: isolation forest on rule statistics.

Every document gets a few counts (words, symbols, repeated lines, repeated windows). Documents
that a plain rule already fails go. The rest are scored by an isolation forest: random splits of
the counts' ratios, grown on small random subsamples, isolate unusual rows after few splits, so a
short mean path means an anomaly. The score from which a document counts as an anomaly is
calibrated on all labelled rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .shared import written
from .words import NOT_SPACE, doc_of, mix, slices, window_hashes

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BINS = 1000


def _count_equal(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry: is it the first of its (document, hash), and how many equal ones there are."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    keys = hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))
    _, at, back, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    first = np.zeros(len(keys), bool)
    first[at] = True
    return first, counts[back]


def _statistics(batches):
    for batch in batches:
        counts = np.zeros((len(STATISTICS), batch.num_rows), np.int64)
        for s in slices(batch.column("text")):
            to = slice(s.first_doc, s.first_doc + s.n_docs)
            inside = NOT_SPACE[s.data]
            starts, ends, first = s.spans(inside)
            counts[0, to] = np.diff(first)
            counts[1, to] = s.sums(inside & ((s.data & 0xC0) != 0x80))  # bytes that begin a code point
            counts[2, to] = s.sums(SYMBOLS[s.data])
            # lines: runs between line feeds; an empty run is no line with a word, so runs suffice
            line_starts, line_ends, first_line = s.spans(s.data != 0x0A)
            worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
            doc = doc_of(first_line)[worded]
            new, _ = _count_equal(doc, s.hashes(line_starts[worded], line_ends[worded]))
            counts[3, to] = np.bincount(doc[~new], minlength=s.n_docs)
            # windows of three words within one document
            doc = doc_of(first)
            windows = window_hashes(s.hashes(starts, ends), 3)
            same = np.flatnonzero(doc[: len(windows)] == doc[2:]) if len(windows) else np.zeros(0, np.int64)
            _, times = _count_equal(doc[same], windows[same])
            hit = np.zeros(len(doc) + 2, bool)
            for j in range(3):
                hit[same[times > 1] + j] = True
            counts[4, to] = np.bincount(doc[hit[: len(doc)]], minlength=s.n_docs)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(c) for c in counts)],
            names=[*batch.schema.names[:-1], *STATISTICS],
        )


def rule_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of every whole text: key, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``. A null or empty text has zeros; every row is kept, repeated rows and null keys too;
    other columns of the input are not read."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_statistics, "doc_id " + kind + "".join(f", {c} long" for c in STATISTICS)) \
        .withColumnRenamed("doc_id", key)


def features(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) -> np.ndarray:
    """Ratios that do not depend on a document's length, one row per document: mean word length, symbols and repetition.

    Symbols run from none to several a word; their fourth root spreads them out, so that random splits tell few from
    none as well as many from few. A little repetition is common; its square keeps it close to none. Repeated lines and
    repeated windows mostly are the same words, so they make one ratio: as two they would count twice."""
    n = np.maximum(np.asarray(n_words, float), 1.0)
    chars, symbols, lines, repeats = (np.asarray(c, float) / n for c in (word_chars, n_symbols, n_dup_lines, n_repeat_words))
    return np.column_stack((chars, symbols**0.25, (lines + repeats) ** 2))


def mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search in a random binary tree of n rows."""
    n = np.asarray(n, float)
    safe = np.maximum(n, 2.0)
    return np.where(n < 2, 0.0, 2 * (np.log(safe - 1 + (n <= 2)) + np.where(n > 2, 0.5772156649, 0.5)) - 2 * (safe - 1) / safe)


class IsolationForest:
    """Trees as flat arrays: feature (-1 in a leaf), threshold, children, and path length at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = 100, subsample: int = 128, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.subsample = min(subsample, max(len(rows), 1))
        depth = int(np.ceil(np.log2(max(self.subsample, 2))))
        self.trees = []
        for _ in range(trees if len(rows) else 0):
            self.trees.append(self._grow(rows[rng.permutation(len(rows))[: self.subsample]], depth, rng))

    @staticmethod
    def _grow(rows, depth, rng):
        feature, threshold, left, right, path = [], [], [], [], []

        def node(part, at):
            me = len(feature)
            for column in (feature, threshold, left, right, path):
                column.append(0)
            lo, hi = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(hi > lo)
            if at >= depth or len(part) <= 1 or not len(wide):
                feature[me], path[me] = -1, at + float(mean_path(len(part)))
                return me
            f = int(rng.choice(wide))
            cut = float(rng.uniform(lo[f], hi[f]))
            low = part[:, f] <= cut
            feature[me], threshold[me] = f, cut
            left[me], right[me] = node(part[low], at + 1), node(part[~low], at + 1)
            return me

        node(rows, 0)
        return tuple(np.array(c) for c in (feature, threshold, left, right, path))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for anomalies, below 0.5 for ordinary rows."""
        if not self.trees or not len(rows):
            return np.full(len(rows), 0.5)
        total = np.zeros(len(rows))
        for feature, threshold, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                going = np.flatnonzero(feature[at] >= 0)
                if not len(going):
                    break
                node = at[going]
                low = rows[going, feature[node]] <= threshold[node]
                at[going] = np.where(low, left[node], right[node])
            total += path[at]
        expected = max(float(mean_path(self.subsample)), 1e-9)
        return 2.0 ** (-total / len(self.trees) / expected)


def fit_forest(stats: DataFrame, key: str = "doc_id", sample_rows: int = 12_800, **settings) -> IsolationForest:
    """Forest on a bounded sample: about ``sample_rows`` rows, chosen by a hash of the key.

    Every tree of an isolation forest sees 128 rows whatever the corpus holds."""
    rows = stats.select(key, *STATISTICS).distinct()  # rows repeated very often must not swell the sample
    n = rows.count()
    if n == 0:
        return IsolationForest(np.zeros((0, 3)), **settings)
    point = F.pmod(F.xxhash64(key, *STATISTICS), F.lit(1 << 30))
    picked = rows.filter(point < int(min(1.0, sample_rows / n) * (1 << 30))).select(*STATISTICS).toPandas()
    picked = picked.sort_values(STATISTICS, kind="stable").to_numpy()
    return IsolationForest(features(*picked.T), **settings)


def calibrate(scored: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality",
              max_good_loss: float = 0.01, default: float = 0.6) -> float:
    """Score from which a row is an anomaly, from all labelled rows that pass the plain rules.

    Among thresholds that lose at most ``max_good_loss`` of the good rows, the one with the largest
    (bad rows found - good rows lost). Labels come to the driver as one count per score bin and label.
    Without both labels present, ``default``."""
    known = labels.filter(F.col(good).isNotNull() & F.col(key).isNotNull()) \
        .groupBy(F.col(key).alias("_key")).agg(F.min(good).alias("_good"))
    binned = (
        scored.filter(~F.col("base_failed"))
        .join(known, scored[key] == known["_key"])
        .groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"), F.col("_good").alias("good"))
        .agg(F.count("*").alias("n")).toPandas()
    )
    bad, fine = np.zeros(BINS + 2), np.zeros(BINS + 2)
    for b, label, n in binned.itertuples(index=False):
        (fine if label == 1 else bad)[b] += n
    if not bad.sum() or not fine.sum():
        return default
    found, lost = bad[::-1].cumsum()[::-1] / bad.sum(), fine[::-1].cumsum()[::-1] / fine.sum()
    gain = np.where(lost <= max_good_loss, found - lost, -1.0)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2]) / BINS  # the middle of equally good thresholds


def forest_verdicts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                    min_words: int = 50, max_repeat_percent: int = 50, **settings) -> DataFrame:
    """Counts and verdict per document: the columns of ``rule_statistics``, ``base_failed``, ``anomaly``, ``kept``.

    * null or empty text: no words, so ``base_failed``; very long texts are read whole
    * repeated rows and null keys each keep a row of their own; equal counts give equal scores (no ties to break)
    * an empty table gives no rows; without labels the threshold is 0.6
    * other columns of ``docs`` and ``labels`` play no part, whatever their names
    """
    stats = written(rule_statistics(docs, key, text), "rule-statistics")
    forest = fit_forest(stats, key, **settings)

    @pandas_udf("double")
    def anomaly(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series(forest.score(features(a, b, c, d, e)))

    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    scored = stats.withColumn("base_failed", failed).withColumn("anomaly", anomaly(*STATISTICS))
    limit = calibrate(scored, labels, key)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS) / BINS < F.lit(limit)))

