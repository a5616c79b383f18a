"""Runs of words with a period, found by minimizers at several scales, and texts without the repeats of their runs.

A run is a stretch of words with smallest period q, at least ``2 * q`` words long, that cannot be extended with that period. Equal words
have equal 64-bit hashes; stretches of 1, 2, 4, ... words are named by hashes of the names of their halves, so two stretches are compared, and
a match is extended to both sides, in a number of steps that is the logarithm of its length.

* Periods below ``2 * LEAST`` come from direct scans: words that equal the one q places on, in stretches of q or more.
* At each scale w (``LEAST``, doubled) come periods from 2 w to below 4 w. Of w successive stretches of w words the one with the least name
  is a minimizer. The first such windows of two successive periods hold the same words, so both have it, q apart: minimizers of equal
  name at such a distance are seeds, and a seed is extended as far as words q apart are equal.
* Stretches that have a period of w / 2 or less themselves occur too densely for that. They lie in runs that lower scales have found, and are
  no minimizers; but the first stretch after such a run is one. So equal minimizers stand more than w / 2 apart, and each has at most seven
  partners. If a whole first period has such a small period d, its run ends beside another one of period d with another phase; the periods of
  runs across their border are known up to multiples of d and are tried directly. There are no more of those than runs.

The same stretch found with several periods has the smallest as its own. All texts of a chunk are searched together, with a word of its own
between them. Memory is some 8 bytes times the logarithm of the longest text for each word of a chunk; a text longer than a chunk is one of
its own and taken whole.

Null texts and texts without words have no runs. Rows that repeat an id are looked at each. Of two runs of equal length the one that starts
first is the longest, then that of smaller period. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm import words as W

#: Words of a minimizer at the first scale, a power of two.
LEAST = 4
NO_NAME = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """``op`` over every n (a power of two) successive values."""
    step = 1
    while step < n:
        x = op(x[: len(x) - step], x[step:]) if len(x) > step else x[:0]
        step *= 2
    return x


class Names:
    """Names of the stretches of 2 ** k words that begin at each place of a sequence."""

    def __init__(self, words: np.ndarray, longest: int):
        self.n = len(words)
        self.levels = [words]
        while 2 << len(self.levels) - 1 <= longest:
            size = 1 << len(self.levels) - 1
            x = self.levels[-1]
            if len(x) <= size:
                break
            self.levels.append(W.mix(W.mix(x[:-size], len(self.levels)) ^ x[size:], 40 + len(self.levels)))

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, size = self.levels[k], 1 << k
            open_ = np.arange(len(a))
            while len(open_):
                x, y = a[open_] + out[open_], b[open_] + out[open_]
                open_, x, y = open_[fits := y < len(level)], x[fits], y[fits]
                open_ = open_[level[x] == level[y]]
                out[open_] += size
                if k < len(self.levels) - 1:
                    break
        return out

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before a equal those before b (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, size = self.levels[k], 1 << k
            open_ = np.arange(len(a))
            while len(open_):
                x, y = a[open_] - out[open_] - size, b[open_] - out[open_] - size
                open_, x, y = open_[fits := x >= 0], x[fits], y[fits]
                open_ = open_[level[x] == level[y]]
                out[open_] += size
                if k < len(self.levels) - 1:
                    break
        return out


class Runs:
    """Runs found so far: ``start``, ``end``, ``period``, without those that repeat one by a multiple of its period."""

    def __init__(self):
        self.rows = np.zeros((0, 3), np.int64)

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([start, end, period], axis=1)[end - start >= 2 * period]])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        self.rows = rows[new]


def extend(names: Names, runs: Runs, x: np.ndarray, period: np.ndarray) -> None:
    """Add the runs of the given periods around places x whose words equal those a period on."""
    if len(x):
        y = x + period
        runs.add(x - names.behind(x, y), y + names.ahead(x, y), period)


def scan(names: Names, runs: Runs, period: int) -> None:
    """All stretches with one period, by comparing words that far apart."""
    x = names.levels[0]
    if len(x) < 2 * period:
        return
    same = np.zeros(len(x) - period + 2, bool)
    same[1:-1] = x[period:] == x[:-period]
    edges = np.flatnonzero(same[1:] != same[:-1])
    start, end = edges[::2], edges[1::2] + period
    runs.add(start, end, np.full(len(start), period))


def seeds(names: Names, runs: Runs, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal minimizers of ``w = 2 ** k`` words, 2 w to below 4 w apart: places and distances."""
    w, name = 1 << k, names.levels[k]
    begin, end, period = runs.rows.T
    dense = (period <= w // 2) & (end - begin >= w)
    inside = np.zeros(len(name) + 1, np.int32)
    np.add.at(inside, begin[dense], 1)
    np.add.at(inside, end[dense] - w + 1, -1)
    periodic = np.cumsum(inside[:-1]) > 0
    key = np.where(periodic, NO_NAME, name)
    chosen = np.zeros(len(name), bool)
    least = _least(key, w, np.minimum)
    if len(least):
        wide = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        chosen = (_least(wide, w, np.maximum) == key) & ~periodic
    chosen[1:] |= periodic[:-1] & ~periodic[1:]
    at = np.flatnonzero(chosen)
    at = at[np.argsort(name[at], kind="stable")]
    named = name[at]
    left, gap = [], []
    for step in range(1, len(at)):
        far = at[step:] - at[:-step]
        near = (named[step:] == named[:-step]) & (far < 4 * w)
        if not near.any():
            break
        near &= far >= 2 * w
        left.append(at[:-step][near])
        gap.append(far[near])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(gap)


def borders(names: Names, runs: Runs, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods from 2 w to below 4 w of runs over the border of two runs of a same period d: places and periods to try."""
    rows = runs.rows[np.lexsort((runs.rows[:, 0], runs.rows[:, 2]))]
    if len(rows) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    (a, a_end, d), (b, b_end, d2) = rows[:-1].T, rows[1:].T
    most = np.minimum(np.minimum(a_end - a, b_end - a_end + d), 4 * w - 1)
    meet = (d == d2) & (b <= a_end) & (most >= 2 * w) & (d <= w // 2)
    places, periods = [], []
    for i in np.flatnonzero(meet):
        # the place within the last period of the first run whose words are those at its end
        back = np.arange(a_end[i] - 2 * d[i] + 1, a_end[i] - d[i] + 1)
        phase = back[names.ahead(back, np.full(len(back), a_end[i])) >= d[i]]
        for x in phase[:1]:
            least = a_end[i] - x
            q = np.arange(least + max(0, -(-(2 * w - least) // d[i])) * d[i], most[i] + 1, d[i])
            places.append(a_end[i] - q)
            periods.append(q)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def find_runs(words: np.ndarray, longest: int) -> np.ndarray:
    """``(start, end, period)`` of every run of a sequence whose runs are at most ``longest`` words long, by start, end."""
    runs = Runs()
    if len(words):
        names = Names(words, longest)
        for period in range(1, min(2 * LEAST, longest // 2 + 1)):
            scan(names, runs, period)
        k = LEAST.bit_length() - 1
        while 4 << k <= longest and k < len(names.levels):
            found, tried = seeds(names, runs, k), borders(names, runs, 1 << k)
            extend(names, runs, *(np.concatenate(x) for x in zip(found, tried, strict=True)))
            k += 1
    return runs.rows


def chunk_runs(words: np.ndarray, first: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of all texts of a chunk with ``shortest`` words or more: text, and ``(start, end, period)`` counted within the text."""
    counts = np.diff(first)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    apart = np.arange(len(words)) + text  # after each text a word that is nowhere else
    line = W.mix(np.arange(len(words) + len(counts), dtype=np.uint64), 77)
    line[apart] = words
    rows = find_runs(line, int(counts.max()))
    rows = rows[rows[:, 1] - rows[:, 0] >= shortest]
    at = first[:-1] + np.arange(len(counts))
    of = np.searchsorted(at, rows[:, 0], side="right") - 1
    of = np.minimum(of, len(counts) - 1)
    return of, rows - np.stack([at[of], at[of], np.zeros(len(of), np.int64)], axis=1)


def damaged(ids: list, first: np.ndarray) -> np.ndarray:
    """The word that stands in each place: in a tenth of the texts, by a hash of the id, a tail of words repeats its beginning."""
    out = np.arange(first[-1])
    for i, low, high in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = high - low
        if i is None or not n:
            continue
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[low + a: high] = low + a + np.arange(n - a) % p
    return out


OUT = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(docs: DataFrame, damage: bool = False, shortest: int = 12, id_col: str = "doc_id", text_col: str = "text", with_runs: bool = False) -> DataFrame:
    """Per row: id, n_runs, the longest run, digests of all runs and of the words outside their repeats; with all runs and that text if asked.

    ``damage`` puts runs in first, as ``damaged`` says; ids must be integers then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for chunk in W.chunks(batch.column(1)):
                n, first = len(chunk.rows), chunk.first
                words, starts, sizes = chunk.words(), chunk.starts, chunk.ends - chunk.starts
                if damage:
                    of = damaged(ids[chunk.rows.start: chunk.rows.stop].to_pylist(), first)
                    words, starts, sizes = words[of], starts[of], sizes[of]
                text, runs = chunk_runs(words, first, shortest)
                order = np.lexsort((runs[:, 2], runs[:, 0], text))
                text, (start, end, period) = text[order], runs[order].T
                length = end - start
                at = np.searchsorted(text, np.arange(n + 1))
                # the longest run of each text
                rank = np.lexsort((period, start, -length, text))
                has = np.flatnonzero(np.diff(at))
                best = rank[at[has]]
                longest = {"start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period}
                columns = {}
                none = np.ones(n, bool)
                none[has] = False
                for name, values in longest.items():
                    out = np.zeros(n, np.int64)
                    out[has] = values[best]
                    columns[name] = pa.array(out, pa.int64(), mask=none)
                lines = np.array([f"{s},{e},{q}\n" for s, e, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)], object)
                # words outside the repeats, with a space after each
                cover = np.zeros(len(words) + 1, np.int32)
                base = first[text]
                np.add.at(cover, base + start + period, 1)
                np.add.at(cover, base + end, -1)
                kept = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
                size = sizes[kept] + 1
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                take = np.arange(ends[-1]) + np.repeat(starts[kept] - ends[:-1], size)
                body = np.append(chunk.data, np.uint8(32))[np.minimum(take, len(chunk.data))]
                body[ends[1:] - 1] = 32
                bounds = ends[np.searchsorted(kept, first)]
                texts = [body[bounds[k]: max(bounds[k], bounds[k + 1] - 1)] for k in range(n)]
                arrays = [ids[chunk.rows.start: chunk.rows.stop], pa.array(np.diff(at), pa.int64()), *columns.values(),
                          pa.array([hashlib.sha256("".join(lines[at[k]: at[k + 1]]).encode()).hexdigest() for k in range(n)], pa.string()),
                          pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                if with_runs:
                    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                    arrays += [pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows), pa.array([t.tobytes().decode() for t in texts], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, {OUT}" + (", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_runs else "")
    names = ["id", *(part.split(" ")[0] for part in OUT.split(", "))] + (["runs", "collapsed"] if with_runs else [])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
