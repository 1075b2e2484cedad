"""Words of many texts at once as 64-bit hashes, by numpy prefix sums instead of a loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE = np.arange(256)
#: Bytes of a word: all but ASCII white space; or ASCII letters and digits, and whatever isn't ASCII.
NOT_SPACE = ~np.isin(_BYTE, list(b" \t\n\x0b\x0c\r"))
WORDLIKE = np.isin(_BYTE, list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) | (_BYTE >= 128)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes whose prefix sums are held at a time; a longer word takes its own length.
CHUNK = 1 << 17
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64, kept by the process for lengths up to CHUNK."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = 1 << max(CHUNK, n - 1).bit_length()
        held = np.ones(size, np.uint64)
        done = 1
        while done < size:
            held[done : 2 * done] = held[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if n <= 2 * CHUNK:
            _POWERS[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes() takes the hash of any span of the values."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * _powers(_BASE, len(values)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans start : end; equal spans have equal ones wherever they lie."""
    return mix((sums[end] - sums[start]) * _powers(_INVERSE, len(sums))[start])


@dataclass
class Words:
    """hashes of all words in order; first[i] : first[i + 1] are those of text i; start, end: byte positions in data."""

    data: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: list[bytes], table: np.ndarray = NOT_SPACE) -> Words:
    """The words of UTF-8 texts. Equal words have equal hashes in every process."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = table[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    del inside, edge
    hashes = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        lo, size = int(start[i]), int(end[j - 1] - start[i])
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[lo : lo + size].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, size), out=sums[1:])
        first = start[i:j] - lo
        hashes[i:j] = mix((sums[end[i:j] - lo] - sums[first]) * _powers(_INVERSE, size)[first])
        i = j
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=bounds[1:])
    return Words(data, hashes, np.searchsorted(start, bounds), start, end)


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of about limit bytes of one text column, of several batches where these are smaller."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for part in portions(batches, column, limit):
        held.append(part)
        size += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if size >= limit:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def portions(batches: Iterator[pa.RecordBatch], column: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches in parts of about limit bytes of one text column, a row at least each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(sizes + 1)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
