"""Words, hashes and shingles of whole batches of texts, computed on Arrow's UTF-8 buffers.

No Python string is made per word: a column of texts is one byte array with
offsets, word borders come from a table look-up of its bytes, and a word's
64-bit hash from prefix sums of its bytes times powers of an odd constant.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from vigilia.llm.common import arrow_map

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)

#: Bytes that end a word: space and the controls from tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: As SPACE, with every other ASCII byte that is no letter or digit.
BREAK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_MULT))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULT, _INVERSE):
        p = np.full(n, base, U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, bytes, offsets) of about `limit` bytes, so that work arrays stay small; a longer text is a run of its own."""
    data, at = text_buffers(batch.column(column))
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, lo + 65536, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the accented Latin letters U+00C0 to U+00DE."""
    out = lower_ascii(data)
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = data[at]
    out[at[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]] += 32
    return out


def word_bounds(data: np.ndarray, at: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in order, and each row's first word (one more than rows)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~breaks[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads = at[:-1][at[:-1] < at[1:]]
    opens[heads] = inside[heads]
    tails = at[1:][at[:-1] < at[1:]] - 1
    closes[tails] = inside[tails]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def hash_word(word: str | bytes) -> int:
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and each row's first (one more than rows); a row of 1 to k-1 words has one shorter run."""
    counts = np.diff(first)
    if not len(words):
        return np.zeros(0, U64), np.zeros(len(first), np.int64)
    runs = np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)
    starts = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(len(counts)), runs)
    at = first[:-1][row] + np.arange(starts[-1]) - starts[:-1][row]
    end = first[1:][row]
    out, padded = np.zeros(len(at), U64), np.concatenate([words, np.zeros(k, U64)])
    for j in range(k):
        out = out * U64(_MULT) + np.where(at + j < end, padded[at + j], U64(0))
    return mix(out), starts


def sorted_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct values in order, how often each occurs, and each row's first (one more than rows)."""
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        values[a:b].sort()
    if not len(values):
        return values, np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][first[:-1] < first[1:]]] = True
    where = np.flatnonzero(new)
    return values[where], np.diff(np.append(where, len(values))), np.searchsorted(where, first)


class HashIndex:
    """Open addressing from 64-bit keys (0 excepted) to their positions, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = U64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.zeros(1 << bits, U64), np.full(1 << bits, -1, np.int32)
        left = np.flatnonzero(keys != 0)
        slot = self._home(keys[left])
        while len(left):
            free = self.places[slot] < 0
            self.places[slot[free]] = left[free]  # of several that want a slot, the last stays
            won = self.places[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(_MULT)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where a key is missing."""
        slot = self._home(keys)
        out = np.where(self.keys[slot] == keys, self.places[slot], -1)
        left = np.flatnonzero((self.keys[slot] != keys) & (self.places[slot] >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            hit = self.keys[slot] == keys[left]
            out[left[hit]] = self.places[slot[hit]]
            more = ~hit & (self.places[slot] >= 0)
            left, slot = left[more], slot[more]
        return out


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each row's values; 0 for a row without any."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def map_texts(frame, function, schema: str, column: str = "text"):
    """Apply `function(batch slice, bytes, offsets) -> dict of arrays or RecordBatch` to all rows of a DataFrame."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, at in slices(batch, column):
                out = function(batch.slice(lo, hi - lo), data, at)
                if out is not None and len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_pydict(out)

    return arrow_map(frame, run, schema)
