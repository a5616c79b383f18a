"""Words, lines and n-grams of whole Arrow batches as numpy arrays: no loop over characters or words.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; these are all ASCII, so
runs of bytes are runs of characters. Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at together, so that the arrays of a chunk stay in cache. A longer text is a chunk of its own.
CHUNK = 1 << 19

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []
#: Words of more bytes take their name from the running hash; masks of the first 0 to 8 bytes of a number.
LONG = 64
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Everything but ASCII letters and bytes of other characters, for words without marks and digits.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = NOT_LETTERS[128:] = False


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        if not isinstance(x, np.ndarray):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))
        # arrays in place, with one more beside them
        y = x >> np.uint64(30)
        x ^= y
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= np.right_shift(x, np.uint64(27), out=y)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= np.right_shift(x, np.uint64(31), out=y)
        return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base of the running hash, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            p = np.ones(1, np.uint64)
            step = base
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(step)])
                step = step * step & 0xFFFFFFFFFFFFFFFF
            made.append(p)
        _powers[:] = made
    return _powers[0], _powers[1]


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows."""
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


class Chunk:
    """Consecutive rows of a string column.

    ``rows``: range of row numbers; ``data``: their bytes; ``at``: where each row begins, and the end. ``starts``, ``ends``: byte
    ranges of the words, ``row``: the row of each word (from 0 in the chunk), ``first``: for each row the number of its first
    word, and the count of words at the end.
    """

    def __init__(self, rows: range, data: np.ndarray, at: np.ndarray, separator: np.ndarray = _SEPARATOR):
        self.rows, self.data, self.at = rows, data, at
        n = len(data)
        # the separators of words by comparisons, which need no table
        word = (data != 32) & (data - np.uint8(9) > 4) if separator is _SEPARATOR else ~separator[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = ~word[:-1]
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = ~word[1:]
        self.starts = np.flatnonzero(word & (before | edge[:-1]))
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, at)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.first))

    def lowered(self) -> np.ndarray:
        """The bytes with a-z for A-Z; those below A are large numbers after the subtraction."""
        return self.data + ((self.data - np.uint8(65) < 26).view(np.uint8) << 5)

    def prefix(self, lower: bool = False) -> np.ndarray:
        """Running hash before each byte, for ``span``; ``lower`` takes A-Z for a-z. A byte counts for its value and one."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        sums = out[1:]
        data = self.lowered() if lower else self.data
        np.add(data, np.uint64(1), out=sums)
        sums *= powers(len(out))[0][: len(sums)]
        np.cumsum(sums, out=sums)
        return out

    def span(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each byte range, the same wherever its bytes stand."""
        h = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
        return mix(h ^ (ends - starts).astype(np.uint64))

    def words(self, lower: bool = False) -> np.ndarray:
        return self.span(self.prefix(lower), self.starts, self.ends)

    def names(self) -> np.ndarray:
        """Hash of each word with a-z for A-Z, other than those of ``words`` and from eight bytes at a time; words of more than ``LONG``
        bytes take theirs from ``span``."""
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = self.lowered()
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        size = self.ends - self.starts
        out = eight[self.starts] & _FIRST[np.minimum(size, 8)]
        more = np.flatnonzero(size > 8)
        for k in range(8, LONG, 8):
            more = more[size[more] > k]
            if not len(more):
                break
            out[more] = mix(out[more], 21) + (eight[self.starts[more] + k] & _FIRST[np.minimum(size[more] - k, 8)])
        out += size.astype(np.uint64) * np.uint64(_BASE)
        out = mix(out, 22)
        far = more[size[more] > LONG]
        if len(far):
            out[far] = self.span(self.prefix(True), self.starts[far], self.ends[far])
        return out


def chunks(column: pa.Array, size: int = CHUNK, separator: np.ndarray = _SEPARATOR) -> Iterator[Chunk]:
    data, offsets = string_buffer(column)
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1)
        at = offsets[begin: end + 1]
        yield Chunk(range(begin, end), data[at[0]: at[-1]], at - at[0], separator)
        begin = end


def stretches(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows that have ``size`` bytes together at most, one row at least."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, side="right")))
        yield begin, end
        begin = end


def lines(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Every line (between line feeds) of every row as a string column of its own, and the row of each."""
    data, offsets = string_buffer(column)
    low, high = int(offsets[0]), int(offsets[-1])
    breaks = np.flatnonzero(data[low:high] == 10) + low
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    row = np.searchsorted(breaks, offsets)
    counts = np.diff(row) + 1
    lengths = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    keep = np.ones(high - low, bool)
    keep[breaks - low] = False
    body = data[low:high][keep]
    built = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.tobytes()), pa.py_buffer(body.tobytes()))
    return built, np.repeat(np.arange(len(counts)), counts)


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows of each row, and their row; a row with fewer words has its whole sequence as one."""
    counts = np.diff(first)
    rows = np.arange(len(counts))
    window = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        window = mix(window, k) ^ words[k: k + len(window)]
    whole = counts >= n
    row = np.repeat(rows, counts)
    fits = row[: len(window)] == row[n - 1: n - 1 + len(window)]
    out, of = [mix(window[fits], n)], [row[: len(window)][fits]]
    for k in range(1, n):
        short = rows[~whole & (counts == k)]
        if len(short):
            h = words[first[short]].copy()
            for j in range(1, k):
                h = mix(h, j) ^ words[first[short] + j]
            out.append(mix(h, k))
            of.append(short)
    out, of = np.concatenate(out), np.concatenate(of)
    if len(of) and n > 1:
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``grams``, by hashes of another kind that cost less: weighted sums of the words' hashes, which must be spread evenly. In the order of
    the words."""
    counts = np.diff(first)
    # a weight for each place, odd and without a pattern, so that other arrangements of the same words have other sums
    weights = mix(np.arange(n, dtype=np.uint64), 23) | np.uint64(1)
    sums = words * weights[0]
    for k in range(1, n):
        sums[: max(0, len(words) - k)] += words[k:] * weights[k]
    row = np.repeat(np.arange(len(counts)), counts)
    # a window stands where it begins, and a row with fewer words at its first
    stands = np.zeros(len(words), bool)
    stands[: max(0, len(words) - n + 1)] = row[: max(0, len(words) - n + 1)] == row[n - 1:]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        at = first[short]
        h = words[at]
        for k in range(1, n):
            longer = np.flatnonzero(counts[short] > k)
            h[longer] = mix(h[longer], k) ^ words[at[longer] + k]
        sums[at], stands[at] = mix(h, n), True
    return mix(sums[stands], n), row[stands]


def distinct(values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, rows in order, values of a row in order."""
    if not len(values):
        return values, row
    if row.max() < 1 << 16:
        # one sort by the row and most of the value; values that differ in the rest alone are next to unknown
        key = row.astype(np.uint64) << np.uint64(48) | values >> np.uint64(16)
        order = np.argsort(key)
        key, sorted_values = key[order], values[order]
        equal = key[1:] == key[:-1]
        if not (equal & (sorted_values[1:] != sorted_values[:-1])).any():
            new = np.ones(len(values), bool)
            new[1:] = ~equal
            return sorted_values[new], (key[new] >> np.uint64(48)).astype(row.dtype)
    order = np.argsort(values)
    # numbers of two bytes are sorted in linear time
    order = order[np.argsort(row[order].astype(np.uint16 if row.max() < 1 << 16 else np.int32), kind="stable")]
    values, row = values[order], row[order]
    new = np.empty(len(values), bool)
    new[0] = True
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[new], row[new]


class Places:
    """Numbers by 64-bit hash, in a table of fixed size with two places for each; a number that finds neither free takes one over."""

    def __init__(self, bits: int):
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.full(1 << bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers, -1 for unknown hashes."""
        place = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        out = np.where(self.keys[place] == hashes, self.numbers[place], -1).astype(np.int64)
        other = np.flatnonzero(out < 0)
        if len(other):
            place = (hashes[other] >> np.uint64(64 - self.bits)).astype(np.int64)
            out[other] = np.where(self.keys[place] == hashes[other], self.numbers[place], -1)
        return out

    def put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        place = (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)
        taken = self.numbers[place] >= 0
        place[taken] = (hashes[taken] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.keys[place], self.numbers[place] = hashes, numbers


class Growing:
    """An array that numbers are appended to."""

    def __init__(self, dtype: type):
        self.data, self.size = np.zeros(1 << 12, dtype), 0

    def append(self, values: np.ndarray) -> None:
        while self.size + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.size: self.size + len(values)] = values
        self.size += len(values)

    @property
    def used(self) -> np.ndarray:
        return self.data[: self.size]
