"""Words of whole texts as numpy arrays, read straight from Arrow buffers inside a task.

A batch is worked in slices of about ``SLICE_BYTES`` of text, cut between documents, so
memory per task is bounded by the batch and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)

#: bytes of a word that is anything but white space
NOT_SPACE = ~_SPACE
#: bytes of a word that is letters, digits or anything beyond ASCII
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: A-Z to a-z, all else as it is
LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
AS_IS = _BYTES.astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash; every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, SLICE_BYTES * 2), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


class Slice:
    """Documents ``first_doc .. first_doc + n_docs`` of a batch, as bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_doc: int, fold: np.ndarray):
        self.first_doc, self.n_docs = first_doc, len(offsets) - 1
        self.data, self.offsets = fold[data], offsets
        self._sums = None

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum per document of a value per byte."""
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of wanted bytes that do not leave their document.

        Returns starts, ends, and per document the index of its first run (one entry more)."""
        n = len(inside)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n_docs + 1, np.int64)
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~inside[:-1]
        tail[:-1] &= ~inside[1:]
        cut = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        head[cut] = inside[cut]
        tail[cut - 1] = inside[cut - 1]
        starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
        if self._sums is None:
            n = len(self.data)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=sums[1:])
            self._sums = sums
        if not len(starts):
            return np.zeros(0, np.uint64)
        back = _power_table(_INVERSE, int(starts.max()) + 1)
        return mix((self._sums[ends] - self._sums[starts]) * back[starts])


def slices(texts: pa.Array, fold: np.ndarray = AS_IS, max_bytes: int = SLICE_BYTES, max_docs: int = 1 << 30) -> Iterator[Slice]:
    """Cut a string column into slices; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    _, places, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(places, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        end = min(end, n, at + max_docs)
        yield Slice(whole[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at, fold)
        at = end


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive hashes (ignoring document borders)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    for j in range(size):
        total += hashes[j : n + j] * factors[j]
    return mix(total ^ np.uint64(size))


def doc_of(first: np.ndarray) -> np.ndarray:
    """Document of each run, from the index of the first run of each document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
