"""Vectorised word scanning over Arrow string columns.

Words are runs of bytes of a class; as all separators are ASCII, byte runs of UTF-8 equal runs of characters.
A word's hash is a polynomial in its bytes modulo 2**64, taken from one running sum over the whole buffer,
so a batch costs a few NumPy passes instead of a Python step for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_M = (1 << 64) - 1
#: Text bytes that are scanned at once; a longer text is scanned in several runs and joined.
SLICE = 1 << 18

SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(_INV)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(19, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _scan(low: np.ndarray, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one run. first marks bytes that begin a text."""
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    before[first] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    cut = first[first > 0]
    after[cut - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    up, down = powers(len(low))
    sums = (low.astype(np.uint64) + np.uint64(1)) * up[: len(low)]
    np.cumsum(sums, out=sums)
    h = sums[ends - 1]
    h[starts > 0] -= sums[starts[starts > 0] - 1]
    return starts, ends, mix(h * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of a run of texts: start and end byte (in data), hash, and the number of the text that holds each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.data, self.offsets = data, offsets
        low, n = _LOWER[data], len(data)
        word = kind[low]
        begins = np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        parts, at = [], 0
        while at < n:
            to = min(n, at + SLICE)
            if to < n:  # a run ends before a byte that is in no word, or before a text
                gap = np.flatnonzero(~word[to : to + SLICE])
                text = begins[np.searchsorted(begins, to) :][:1]
                stops = [*(gap[:1] + to), *text] or [n]
                while len(gap) == 0 and min(stops) > to + SLICE:  # one word longer than a run
                    to += SLICE
                    gap = np.flatnonzero(~word[to : to + SLICE])
                    stops = [*(gap[:1] + to), *text] or [n]
                    if to >= n:
                        break
                to = int(min(n, min(stops)))
            inside = begins[np.searchsorted(begins, at) : np.searchsorted(begins, to)] - at
            s, e, h = _scan(low[at:to], word[at:to], inside)
            parts.append((s + at, e + at, h))
            at = to
        self.start, self.end, self.hash = (np.concatenate(x) if parts else np.empty(0, t) for x, t in zip(zip(*parts) if parts else ((),) * 3, (np.int64, np.int64, np.uint64), strict=True))
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        #: Words of text i are bounds[i]:bounds[i + 1].
        self.bounds = np.searchsorted(self.start, offsets)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the len + 1 offsets of its texts (null: empty)."""
    col = col.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in row runs of about size bytes of text, so that memory follows one run, or one text."""
    col = batch.column(batch.schema.get_field_index(column))
    _, offsets = buffers(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size)))
        yield batch.slice(at, min(to, len(col)) - at)
        at = to


def scan(batch: pa.RecordBatch, column: str, kind: np.ndarray) -> Words:
    data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    return Words(data, offsets, kind)
