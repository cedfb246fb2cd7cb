"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every whole document is scanned: its windows of words are hashed in a task, looked up in the set, and
each hit is verified word by word. The set is made and broadcast in blocks of bounded size. One block is one scan
without a shuffle. With more, each block is made when the one before it has been scanned and released, and
writes what it found; the finds of a text are then put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, written
from .words import ALNUM, LOWER, doc_of, slices, window_hashes

_FILTER_BITS = 20
_ENTRY_BYTES = 350  # what a window takes in a table besides its words
_CHUNK = 1000


class Block:
    """Windows of some items: hash -> the items whose windows have it, and a bit table to pass over the rest."""

    def __init__(self):
        self.items: list[str] = []
        self.windows: dict[int, dict[int, list[tuple[bytes, int]]]] = {}  # by size, by hash
        self.filters: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, item: str, size: int, windows: list[tuple[int, bytes]]) -> None:
        own = len(self.items)
        self.items.append(item)
        table = self.windows.setdefault(size, {})
        bits = self.filters.setdefault(size, np.zeros(1 << _FILTER_BITS, bool))
        for code, window in windows:
            bits[code >> (64 - _FILTER_BITS)] = True
            entry = (window, own)
            same = table.setdefault(code, [])
            if entry not in same:
                same.append(entry)
                self.size += len(window) + _ENTRY_BYTES


def blocks_of(items: Iterator[tuple[object, str | None]], n: int, max_bytes: int) -> Iterator[Block]:
    """Blocks one at a time; an item of many windows is spread over several."""
    block = Block()
    for item, text in items:
        for s in slices(pa.array([text or ""]), LOWER):
            starts, ends, _ = s.spans(ALNUM[s.data])
            size = min(n, len(starts))
            codes = window_hashes(s.hashes(starts, ends), size) if size else np.zeros(0, np.uint64)
            for lo in range(0, len(codes), _CHUNK):
                some = [(int(codes[i]), b" ".join(s.data[a:b].tobytes() for a, b in zip(starts[i : i + size], ends[i : i + size])))
                        for i in range(lo, min(lo + _CHUNK, len(codes)))]
                block.add("" if item is None else str(item), size, some)
                if block.size >= max_bytes:
                    yield block
                    block = Block()
    yield block


def _hits(s, starts, ends, first, block: Block) -> tuple[np.ndarray, list[set[str]]]:
    """Which words of a slice lie in an occurring window, and the items found per document."""
    hashes, doc = s.hashes(starts, ends), doc_of(first)
    cover = np.zeros(len(starts) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(s.n_docs)]
    for size, table in block.windows.items():
        codes = window_hashes(hashes, size)
        if not len(codes):
            continue
        maybe = np.flatnonzero(block.filters[size][(codes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        maybe = maybe[doc[maybe] == doc[maybe + size - 1]]
        for i in maybe.tolist():
            same = table.get(int(codes[i]))
            if not same:
                continue
            text = b" ".join(s.data[starts[j] : ends[j]].tobytes() for j in range(i, i + size))
            for window, item in same:
                if window == text:
                    cover[i] += 1
                    cover[i + size] -= 1
                    found[doc[i]].add(block.items[item])
    return np.cumsum(cover[:-1]) > 0, found


def _scanner(shared, text: str, carry: list[str], clean_only: bool, found_only: bool = False):
    def scan(batches):
        block = shared.value
        for batch in batches:
            n_words, n_hit = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for s in slices(batch.column(text), LOWER):
                starts, ends, first = s.spans(ALNUM[s.data])
                hit, found = _hits(s, starts, ends, first, block)
                for d in range(s.n_docs):
                    at = s.first_doc + d
                    a, b = int(first[d]), int(first[d + 1])
                    n_words[at] = b - a
                    if found[d]:
                        own = hit[a:b]
                        n_hit[at] = int(own.sum())
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
                        spans[at], items[at] = edge.tolist(), sorted(found[d])
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(n_words), pa.array(n_hit),
                 pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                names=[*carry, "_n_words", "_n_hit", "_spans", "_items"],
            )
            if clean_only or found_only:
                out = out.filter(pa.array((n_hit == 0) if clean_only else (n_hit > 0)))
            yield out

    return scan


FOUND = "_n_words long, _n_hit long, _spans array<int>, _items array<string>"


def _scanned(docs: DataFrame, block: Block, text: str, carry: list[str], **wanted):
    """Rows of one scan, and the broadcast it uses."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry) + FOUND
    return docs.mapInArrow(_scanner(shared, text, carry, wanted.get("clean_only", False), wanted.get("found_only", False)), schema), shared


def _word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def _put_together(parts: DataFrame) -> DataFrame:
    """(_of, _n_hit, _spans, _items) per text from what the blocks found: hit runs joined where they touch, ids once."""
    runs = F.flatten(F.collect_list(F.transform(
        F.filter(F.transform("_spans", lambda v, i: F.struct(v.alias("lo"), F.get("_spans", i + 1).alias("hi"), i.alias("i"))), lambda e: e["i"] % 2 == 0),
        lambda e: F.struct(e["lo"], e["hi"]))))
    grouped = parts.groupBy(F.struct("_tag").alias("_k")).agg(F.array_sort(runs).alias("_runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"))

    def joined(done, run):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], run["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (run["lo"] <= last["hi"]), longer).otherwise(F.concat(done, F.array(F.struct(run["lo"].alias("lo"), run["hi"].alias("hi")))))

    whole = F.aggregate("_runs", F.array().cast("array<struct<lo:int,hi:int>>"), joined)
    return grouped.select(F.col("_k._tag").alias("_of"), whole.alias("_whole"), "_items").select(
        "_of", F.aggregate("_whole", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"]).alias("_n_hit"),
        F.flatten(F.transform("_whole", lambda r: F.array(r["lo"], r["hi"]))).alias("_spans"), "_items")


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
               item_text: str = "text", n: int = 10, block_bytes: int = 32 << 20, keep: list[str] | None = None,
               clean_only: bool = False) -> DataFrame:
    """``keep`` columns (all by default) of every document with what its text shares with the benchmark items.

    ``_n_words``; ``_n_hit``: words inside occurring windows; ``_spans``: first word and end of each hit run;
    ``_items``: ids, as text, of the items with a window in the document, sorted.
    ``clean_only`` leaves out the documents that share anything.

    * a window is ``n`` consecutive words; an item of fewer words, but not none, is one window
    * null or empty texts have no words and are clean; items without words match nothing; a null item id is ''
    * items with equal texts are all reported; items that share an id count once
    * repeated rows and null keys are rows like any other; an empty table gives no rows, an empty benchmark no hits
    * columns of ``docs`` called ``_n_words``, ``_n_hit``, ``_spans`` or ``_items`` are replaced
    """
    docs = docs.drop("_n_words", "_n_hit", "_spans", "_items")
    names = keep if keep is not None else docs.columns
    items = benchmark.select(F.col(item_key), F.col(item_text)).toLocalIterator()  # a partition of items at a time
    blocks = blocks_of(((r[0], r[1]) for r in items), n, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _scanned(docs.select(*dict.fromkeys([*names, text])), block, text, names, clean_only=clean_only)[0]
    # equal texts share all finds, so finds are kept by a digest of the text
    told = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_tag"), F.col(text).alias("_text"))
    parts = []
    while block is not None:
        found, shared = _scanned(told, block, "_text", ["_tag"], found_only=True)
        parts.append(written(found.dropDuplicates(["_tag"]), "leaks"))
        shared.destroy()
        block, following = following, next(blocks, None) if following is not None else None
    every = written(_put_together(reduce(DataFrame.unionByName, parts)), "leaks")
    discard(*parts)
    rows = docs.select(*names, F.md5(F.coalesce(F.col(text), F.lit(""))).alias("_tag"), _word_count(F.col(text)).alias("_n_words"))
    out = rows.join(every, F.col("_tag") == F.col("_of"), "left").select(
        *names, "_n_words", F.coalesce("_n_hit", F.lit(0)).cast("long").alias("_n_hit"), F.coalesce("_spans", F.array().cast("array<int>")).alias("_spans"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("_items"))
    return out.filter("_n_hit = 0") if clean_only else out


def redact(text: str, spans: list[int]) -> str:
    """The text without the hit runs of words that ``find_leaks`` reports, and without what stands between
    the words of a run."""
    data = pa.array([text])
    s = next(slices(data, LOWER))
    starts, ends, _ = s.spans(ALNUM[s.data])
    raw, out, at = text.encode(), [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()
