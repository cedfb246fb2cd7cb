"""Which tokens of two tokenizers cover the same bytes, over a whole corpus.

Both tokenizers encode every whole text; the byte offsets where tokens of both end cut a text into groups. The two arrays of
ends are compared by diagonal run skipping: at the present index shift a probe compares 1, 2, 4, ... ends at once and
jumps a stretch of one-to-one tokens; where it fails, the irregular group is resolved by stepping over the lesser end until both
meet, and the shift is updated. Many stretches ("lanes") of a batch are walked side by side, so each step is one array operation.

Pairs of tokens in a group are linked. How many documents link a pair is counted over the corpus; the counts are then looked up for
every document, from blocks of the pair table whose size is bounded, one broadcast at a time and released before the next.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: fixed value: how a byte-level tokenizer cuts a text before merging
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE_CHARS = 1 << 20
LANE = 64
LONG_RUN = 1000
#: A group of more links is paired by its distinct tokens.
WIDE = 4096
BLOCK_PAIRS = 4_000_000

_known: dict[bytes, Codec] = {}


def _byte_of_letter() -> dict[str, int]:
    """Byte-level letters: printable bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Codec:
    """The two tokenizers, the bytes of their tokens, and the printed form of their ids."""

    def __init__(self, json_file: bytes, model_file: bytes):
        import sentencepiece
        import tiktoken
        import tokenizers

        letters = _byte_of_letter()
        entries = json.loads(json_file)
        special = {t["content"] for t in entries["added_tokens"]}
        vocabulary = {t: i for t, i in entries["model"]["vocab"].items() if t not in special}
        a_bytes = {i: bytes(map(letters.__getitem__, t)) for t, i in vocabulary.items()}
        self.size_a = 1 + max([*entries["model"]["vocab"].values(), *(t["id"] for t in entries["added_tokens"])])
        self.fast = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks={b: i for i, b in a_bytes.items()}, special_tokens={})
        self.exact = tokenizers.Tokenizer.from_str(json_file.decode())
        self.exact.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_file)
        self.size_b = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.size_b)))]
        self.a_width = np.array([len(a_bytes.get(i, b"")) for i in range(self.size_a)], np.int64)
        self.b_width = np.array(list(map(len, self.b_bytes)), np.int64)
        printed = [f"{i}{mark}".encode() for size, marks in ((self.size_a, ",|"), (self.size_b, ",;")) for mark in marks for i in range(size)]
        self.printed_width = np.array(list(map(len, printed)), np.int64)
        self.printed = np.array(printed).view(np.uint8).reshape(len(printed), -1)

    def encode_a(self, text: str, raw: np.ndarray) -> np.ndarray:
        """Ids of space + text. Very long pieces go to the slower encoder, whose time does not grow with their square."""
        blank = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
        turns = np.flatnonzero(np.concatenate(([True], blank[1:] != blank[:-1], [True])))
        if np.diff(turns).max() < LONG_RUN:
            return self.fast.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
        return np.array(self.exact.encode(" " + text, add_special_tokens=False).ids, np.int64)


def codec(files: tuple[bytes, bytes]) -> Codec:
    """One per worker process."""
    name = hashlib.sha256(files[0] + files[1]).digest()
    if name not in _known:
        _known[name] = Codec(*files)
    return _known[name]


def _met(ea: np.ndarray, eb: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each (i, j), the next place where both ends are equal: step over the lesser one."""
    i, j = i.copy(), j.copy()
    todo = np.arange(len(i))
    while len(todo):
        x, y = ea[i[todo]], eb[j[todo]]
        i[todo] += x < y
        j[todo] += y < x
        todo = todo[x != y]
    return i, j


def common_ends(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (into ``ea``, into ``eb``) of the ends both arrays hold; both ascend strictly and have the same last entry."""
    n = len(ea)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # lanes begin after the first common end from every LANE-th token on
    i = np.arange(LANE - 1, n, LANE)
    i, j = _met(ea, eb, i, np.searchsorted(eb, ea[i]))
    i, first = np.unique(np.concatenate(([0], i + 1)), return_index=True)
    j = np.concatenate(([0], j + 1))[first]
    stop = np.append(i[1:], n)
    i, j, stop = i[i < n], j[i < n], stop[i < n]
    probe = np.ones(len(i), np.int64)
    found_a, found_b = [], []
    while len(i):
        broken = np.zeros(len(i), bool)
        for width in np.unique(probe):
            lanes = np.flatnonzero(probe == width)
            along = np.arange(width)
            at_a, at_b = i[lanes, None] + along, j[lanes, None] + along
            inside = at_a < stop[lanes, None]
            same = inside & (ea[np.minimum(at_a, n - 1)] == eb[np.minimum(at_b, len(eb) - 1)])
            run = np.where(same.all(1), width, np.argmin(same, 1))
            held = along < run[:, None]
            found_a.append(at_a[held])
            found_b.append(at_b[held])
            i[lanes] += run
            j[lanes] += run
            broken[lanes] = run < width
        probe *= 2
        odd = np.flatnonzero(broken & (i < stop))
        if len(odd):
            a, b = _met(ea, eb, i[odd], j[odd])
            found_a.append(a)
            found_b.append(b)
            i[odd], j[odd], probe[odd] = a + 1, b + 1, 1
        go = i < stop
        i, j, stop, probe = i[go], j[go], stop[go], probe[go]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(a)
    return a[order], b[order]


class Aligned:
    """Token ids of some texts one after another, and the groups that common ends cut them into."""

    def __init__(self, coder: Codec, texts: list[str]):
        self.coder, ids_a, ids_b, ends_a, ends_b, self.docs, base = coder, [], [], [], [], [], 0
        for doc, (text, b) in enumerate(zip(texts, coder.b.encode(texts, num_threads=1))):
            raw = text.encode()
            if not raw or b"".join(map(coder.b_bytes.__getitem__, b)) != b" " + raw:
                continue
            a, b = coder.encode_a(text, np.frombuffer(raw, np.uint8)), np.array(b, np.int64)
            ea, eb = np.cumsum(coder.a_width[a]), np.cumsum(coder.b_width[b])
            if ea[-1] != len(raw) + 1:
                continue
            self.docs.append(doc)
            for out, x in ((ids_a, a), (ids_b, b), (ends_a, base + ea), (ends_b, base + eb)):
                out.append(x)
            base += len(raw) + 1
        joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.n_a, self.n_b = (np.array(list(map(len, x)), np.int64) for x in (ids_a, ids_b))
        self.a, self.b = joined(ids_a), joined(ids_b)
        last_a, last_b = common_ends(joined(ends_a), joined(ends_b))
        self.first_a, self.first_b = (np.append(0, x[:-1] + 1) if len(x) else x for x in (last_a, last_b))
        self.size_a, self.size_b = last_a + 1 - self.first_a, last_b + 1 - self.first_b
        self.doc = np.searchsorted(np.cumsum(self.n_a), last_a, "right")  # of each group

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        """Exact sums of a number per group."""
        sums = np.append(0, np.cumsum(values))
        edges = np.searchsorted(self.doc, np.arange(len(self.docs) + 1))
        return sums[edges[1:]] - sums[edges[:-1]]

    def digests(self) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` of each text."""
        c, n = self.coder, len(self.a) + len(self.b)
        if not n:
            return []
        group_a, group_b = np.repeat(np.arange(len(self.size_a)), self.size_a), np.repeat(np.arange(len(self.size_b)), self.size_b)
        row = np.empty(n, np.int64)
        last = np.arange(len(self.a)) + 1 == (self.first_a + self.size_a)[group_a]
        row[np.arange(len(self.a)) + self.first_b[group_a]] = self.a + last * c.size_a
        last = np.arange(len(self.b)) + 1 == (self.first_b + self.size_b)[group_b]
        row[np.arange(len(self.b)) + (self.first_a + self.size_a)[group_b]] = 2 * c.size_a + self.b + last * c.size_b
        width = c.printed_width[row]
        flat = c.printed[row][np.arange(c.printed.shape[1]) < width[:, None]].tobytes()
        ends = np.append(0, np.cumsum(width))[np.append(0, np.cumsum(self.n_a + self.n_b))]
        return [hashlib.sha256(flat[lo : hi - 1]).hexdigest() for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair code, occurrences) of each distinct linked pair, ordered by document and code."""
        c, many = self.coder, self.size_a * self.size_b
        usual = np.flatnonzero(many <= WIDE)
        group = np.repeat(usual, many[usual])
        nth = np.arange(len(group)) - np.repeat(np.cumsum(many[usual]) - many[usual], many[usual])
        left, right = self.first_a[group] + nth // self.size_b[group], self.first_b[group] + nth % self.size_b[group]
        docs, codes, times = [self.doc[group]], [self.a[left] * c.size_b + self.b[right]], [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(many > WIDE):
            a, of_a = np.unique(self.a[self.first_a[g] : self.first_a[g] + self.size_a[g]], return_counts=True)
            b, of_b = np.unique(self.b[self.first_b[g] : self.first_b[g] + self.size_b[g]], return_counts=True)
            codes.append((a[:, None] * c.size_b + b).ravel())
            times.append((of_a[:, None] * of_b).ravel())
            docs.append(np.full(len(codes[-1]), self.doc[g]))
        doc, code, times = map(np.concatenate, (docs, codes, times))
        space = c.size_a * c.size_b
        key = doc * space + code
        if len(codes) == 1:  # every occurrence counts one: sorting the keys is enough
            key = np.sort(key)
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            times = np.diff(np.append(head, len(key)))
        else:
            order = np.argsort(key)
            key, times = key[order], times[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            times = np.add.reduceat(times, head) if len(head) else times
        return key[head] // space, key[head] % space, times


def _list_column(n: int, doc: np.ndarray, values: np.ndarray, kind) -> pa.Array:
    edges = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.astype(kind)))


ENCODED = "row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def _encoded(files):
    def run(batches):
        coder, row = codec(files.value), TaskContext.get().partitionId() << 33
        if coder.size_a * coder.size_b >= 1 << 31:
            raise ValueError("pair codes of these vocabularies do not fit 31 bits")
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
                    size += len(texts[end])
                    end += 1
                n, aligned = end - at, Aligned(coder, texts[at:end])
                whole = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
                for name, values in (("n_a", aligned.n_a), ("n_b", aligned.n_b), ("n_groups", aligned.per_doc(np.ones(len(aligned.doc), np.int64))),
                                     ("n_links", aligned.per_doc(aligned.size_a * aligned.size_b))):
                    whole[name][aligned.docs] = values
                digests = [""] * n
                for doc, digest in zip(aligned.docs, aligned.digests()):
                    digests[doc] = digest
                doc, code, times = aligned.links()
                doc = np.array(aligned.docs, np.int64)[doc]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(at, n), pa.array(row + np.arange(n)), *map(pa.array, whole.values()), pa.array(digests, pa.string()),
                     _list_column(n, doc, code, np.int32), _list_column(n, doc, times, np.int32)],
                    names=["key", "row", *whole, "groups_sha256", "pairs", "times"])
                row += n
                at = end

    return run


def _counted(batches):
    """(pair, docs), added up within a task as far as a bounded table goes."""
    held, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out():
        return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(docs)], names=["pair", "docs"])

    for batch in batches:
        own, times = np.unique(batch.column("pairs").flatten().to_numpy(zero_copy_only=False).astype(np.int64), return_counts=True)
        held, back = np.unique(np.concatenate((held, own)), return_inverse=True)
        docs = np.bincount(back, np.concatenate((docs, times)), len(held)).astype(np.int64)
        if len(held) > BLOCK_PAIRS:
            yield out()
            held, docs = held[:0], docs[:0]
    yield out()


def _looked_up(block):
    """Per row, the occurrences of pairs of the block that are best for their A token, and the sum of their counts."""

    def run(batches):
        pairs, counts, best = block.value
        for batch in batches:
            lists = batch.column("pairs")
            own, times = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists, batch.column("times")))
            edges = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            times = np.where(pairs[at] == own, times, 0) if len(pairs) else times * 0
            summed = []
            for values in (times * best[at], times * counts[at]) if len(pairs) else (times, times):
                sums = np.append(0, np.cumsum(values))
                summed.append(pa.array(sums[edges[1:]] - sums[edges[:-1]]))
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*rest, *summed], names=[n for n in batch.schema.names if n not in ("pairs", "times")] + ["n_best", "count_sum"])

    return run


def pair_counts(encoded: DataFrame, size_b: int) -> DataFrame:
    """(pair, docs, best): how many documents link a pair, and whether no other pair of its A token is linked by more."""
    counts = encoded.select("pairs").mapInArrow(_counted, "pair int, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    counts = written(counts, "token-pairs")
    # one row per entry of a vocabulary
    most = counts.groupBy(F.floor(F.col("pair") / size_b).alias("_a")).agg(F.max("docs").alias("_most"))
    return counts.join(F.broadcast(most), F.floor(F.col("pair") / size_b) == F.col("_a")).select("pair", "docs", (F.col("docs") == F.col("_most")).alias("best"))


def aligned_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json",
                   b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per row of ``docs``: key, ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A links B if their byte ranges share a group; a pair's count is the number of rows of ``docs`` that link it. ``n_best`` counts
    links whose count is the highest of their A id (ties included), ``count_sum`` adds the counts of all links.

    * null and empty texts, and texts that a tokenizer changes, have no tokens: zeros, and an empty ``groups_sha256``
    * special tokens inside texts are plain text; texts of any length are encoded whole
    * repeated rows count as documents of their own; a null key is carried along
    * an empty table gives no rows; other columns play no part, whatever their names

    Both tokenizer files are read on the driver and broadcast (their size is that of the files). The pair table is never broadcast
    whole: it is cut by hash into blocks of about ``block_pairs``, and each is looked up in a scan of its own.
    """
    spark = docs.sparkSession
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        data = a.read(), b.read()
    files = spark.sparkContext.broadcast(data)
    size_b = codec(data).size_b
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    encoded = written(rows.mapInArrow(_encoded(files), f"key {kind}, {ENCODED}"), "token-groups")
    files.unpersist()
    counts = written(pair_counts(encoded, size_b), "token-counts")
    blocks = max(1, -(-counts.count() // block_pairs))
    plain = ", ".join(f for f in f"key {kind}, {ENCODED}".split(", ") if not f.endswith("array<int>"))
    parts = []
    for nth in range(blocks):
        own = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == nth).toArrow()
        pairs = own["pair"].to_numpy().astype(np.int64)
        order = np.argsort(pairs)
        block = spark.sparkContext.broadcast((pairs[order], own["docs"].to_numpy()[order], own["best"].to_numpy()[order].astype(np.int64)))
        found = encoded if blocks == 1 else encoded.select("row", "pairs", "times")
        parts.append(written(found.mapInArrow(_looked_up(block), (plain if blocks == 1 else "row long") + ", n_best long, count_sum long"), "token-looked-up"))
        block.destroy()
    result = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            result = result.unionByName(part)
        sums = result.groupBy(F.col("row").alias("_row")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        result = encoded.join(sums, F.col("row") == F.col("_row"))
    else:
        discard(encoded)
    discard(counts)
    return result.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
