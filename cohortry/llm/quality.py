"""Quality rules: fixed base rules, then a logistic regression on hashed word and character n-grams with calibrated probability.

Features of a text are the shares of its word 1- and 2-grams (lower-cased), of its byte 4-grams, and of the same with letters, capitals
and digits each as one, that fall into each of ``2**BITS`` buckets per kind, so long and short texts compare. The regression is fitted in numpy on at most ``most`` labelled rows,
those with the lowest hash of their id; a fifth of them, chosen by another hash, is kept out of the fit and calibrates the
probability (Platt scaling), if it has enough rows of both labels. Scoring goes over Arrow batches and keeps a text if its probability is at least a fixed threshold.

Null text has no words and fails the base rules; so do empty and blank texts. Labelled rows without text, or with a null label, teach
nothing. Without both labels among the rows, the fitted model says 1 for every text and only the base rules remain. Rows that repeat
an id are scored as rows of their own. An empty table gives no rows. Columns other than those named play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm import words as W

BITS = 17
KINDS = 4
#: With fewer rows of a label than this to calibrate on, all rows are fitted and calibrated on.
FEW = 10
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: Bytes by their class: letters, capitals and digits each as one.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("9")


@dataclass
class Model:
    """Weights of the buckets of all kinds, then bias; slope and shift of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def features(chunk: W.Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature the buckets and where those of each row begin."""
    hashes = chunk.words(lower=True)
    mask = np.uint64((1 << BITS) - 1)
    out = [((hashes & mask).astype(np.int64), chunk.first)]
    pairs, of = W.grams(hashes, chunk.first, 2)
    out.append(((pairs & mask).astype(np.int64) + (1 << BITS), np.searchsorted(of, np.arange(len(chunk.rows) + 1))))
    # byte windows that begin in a row and reach into the next belong to neither
    n = max(0, len(chunk.data) - 3)
    begins, ends = np.minimum(chunk.at[:-1], n), np.minimum(np.maximum(chunk.at[1:] - 3, chunk.at[:-1]), n)
    first = np.concatenate([[0], np.cumsum(ends - begins)])
    inside = np.arange(first[-1]) + np.repeat(begins - first[:-1], ends - begins)
    for kind, data in ((2, chunk.data), (3, _SHAPE[chunk.data])):
        data = data.astype(np.uint32)
        four = data[:n] | data[1: n + 1] << np.uint32(8) | data[2: n + 2] << np.uint32(16) | data[3: n + 3] << np.uint32(24)
        four = (four * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        out.append((four[inside].astype(np.int64) + (kind << BITS), first))
    return out


def sums_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def raw_score(chunk: W.Chunk, model: Model) -> np.ndarray:
    z = np.full(len(chunk.rows), model.bias)
    for buckets, first in features(chunk):
        z += sums_by_row(model.weights[buckets].astype(np.float64), first) / np.maximum(np.diff(first), 1)
    return z


def base_counts(chunk: W.Chunk) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_repeat_words of each row; words as they stand."""
    n = len(chunk.rows)
    head = np.concatenate([[0], np.cumsum((chunk.data & 0xC0) != 0x80)])  # code points: bytes that begin one
    chars = sums_by_row(head[chunk.ends] - head[chunk.starts], chunk.first)
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[chunk.data])])
    repeated = np.zeros(n, np.int64)
    hashes = chunk.words()
    m = max(0, len(hashes) - 2)
    if m:
        three = W.mix(W.mix(hashes[:m], 1) ^ hashes[1: m + 1], 2) ^ hashes[2: m + 2]
        at = np.flatnonzero(chunk.row[:m] == chunk.row[2: m + 2])
        key = W.mix(three[at] ^ W.mix(chunk.row[at].astype(np.uint64), 3))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = np.zeros(len(hashes), bool)
        begin = at[twice]
        covered[begin] = covered[begin + 1] = covered[begin + 2] = True
        repeated = sums_by_row(covered, chunk.first)
    return {"n_words": np.diff(chunk.first), "word_chars": chars, "n_symbols": symbols[chunk.at[1:]] - symbols[chunk.at[:-1]],
            "n_repeat_words": repeated}


def duplicate_lines(chunk: W.Chunk) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    breaks = np.flatnonzero(chunk.data == 10)
    starts = np.sort(np.concatenate([chunk.at[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([chunk.at[1:], breaks]), kind="stable")
    row = np.repeat(np.arange(len(chunk.rows)), np.diff(np.searchsorted(breaks, chunk.at)) + 1)
    worded = np.searchsorted(chunk.starts, ends) > np.searchsorted(chunk.starts, starts)
    starts, ends, row = starts[worded], ends[worded], row[worded]
    key = W.mix(chunk.span(chunk.prefix(), starts, ends) ^ W.mix(row.astype(np.uint64), 4))
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return np.bincount(row[later], minlength=len(chunk.rows))


def labelled(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label: str) -> DataFrame:
    """At most ``most`` labelled rows ``(id, label, text)``, those with the lowest hash of their id."""
    known = (labels.where(F.col(label).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
             .groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.where(F.col("text").isNotNull()).join(known, "id").groupBy("id", "label").agg(F.max("text").alias("text"))


def gather(docs: DataFrame, labels: DataFrame, most: int, id_col: str, text_col: str, label: str) -> tuple:
    """Ids, labels and features (buckets, shares, row bounds) of the labelled rows: what the fit works on, bounded by ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(2)):
                kinds = features(chunk)
                out = []
                for k in range(len(chunk.rows)):
                    buckets, shares = [], []
                    for b, first in kinds:
                        own, count = np.unique(b[first[k]: first[k + 1]], return_counts=True)
                        buckets.append(own)
                        shares.append(count / max(1, count.sum()))
                    out.append((np.concatenate(buckets).astype("<i4").tobytes(), np.concatenate(shares).astype("<f4").tobytes()))
                at = slice(chunk.rows.start, chunk.rows.stop)
                yield pa.RecordBatch.from_arrays([batch.column(0)[at], batch.column(1)[at], pa.array([o[0] for o in out], pa.binary()),
                                                  pa.array([o[1] for o in out], pa.binary())], ["id", "label", "buckets", "shares"])

    rows = labelled(docs, labels, most, id_col, text_col, label).select("id", "label", "text")
    got = rows.mapInArrow(run, "id long, label int, buckets binary, shares binary").toPandas().sort_values("id")
    ids, y = got["id"].to_numpy(np.int64), got["label"].to_numpy(float)
    bounds = np.concatenate([[0], np.cumsum([len(b) // 4 for b in got["buckets"]])]).astype(np.int64)
    buckets = np.frombuffer(b"".join(got.pop("buckets")), "<i4")
    shares = np.frombuffer(b"".join(got.pop("shares")), "<f4")
    return ids, y, buckets, shares, bounds


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of Platt scaling by bounded Newton steps, with smoothed targets and the slope drawn to 1; ``n``: how many rows each
    entry stands for."""
    n = np.ones(len(y)) if n is None else n
    up, down = (y * n).sum(), ((1 - y) * n).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = logistic(a * z + b)
        w, off = n * np.maximum(p * (1 - p), 1e-9), n * (p - target)
        g = np.array([(off * z).sum() + (a - 1), off.sum()])
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, most: int = 3000, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
        rounds: int = 200, rate: float = 0.5, ridge: float = 1e-6) -> Model:
    """Fit on at most ``most`` labelled rows by Adam on all of them at once."""
    ids, y, buckets, shares, bounds = gather(docs, labels, most, id_col, text_col, label)
    size = KINDS << BITS
    if len(np.unique(y)) < 2:
        return Model(np.zeros(size, np.float32), 40.0, 1.0, 0.0)
    aside = (W.mix(ids.astype(np.uint64), 5) % np.uint64(5)) == 0
    if min(y[aside].sum(), (1 - y[aside]).sum()) < FEW:
        aside[:] = False
    learn = ~aside
    used = np.unique(buckets)
    where = np.searchsorted(used, buckets).astype(np.int32)
    del buckets
    row = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(bounds))
    w, m, v = (np.zeros(len(used) + 1, np.float32) for _ in range(3))
    weight = np.where(y > 0, 0.5 / y[learn].sum(), 0.5 / (learn.sum() - y[learn].sum())) * learn
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=shares * w[where], minlength=len(y)) + w[-1]
        error = ((logistic(z) - y) * weight).astype(np.float32)
        g = np.append(np.bincount(where, weights=shares * error[row], minlength=len(used)), error.sum()) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    z = np.bincount(row, weights=shares * w[where], minlength=len(y)) + w[-1]
    rest = aside if aside.any() else learn
    slope, shift = calibrate(z[rest], y[rest])
    weights = np.zeros(size, np.float32)
    weights[used] = w[:-1]
    return Model(weights, float(w[-1]), slope, shift)


def assess(docs: DataFrame, model: Model, threshold: float = 0.5, least_words: int = 50, repeat_share: float = 0.5,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, base counts, base_failed, probability, kept."""
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)  # 2**BITS * KINDS numbers, whatever the corpus
    bias, slope, shift = model.bias, model.slope, model.shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model(weights.value, bias, slope, shift)
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                counts = base_counts(chunk)
                counts["n_dup_lines"] = duplicate_lines(chunk)
                failed = (counts["n_words"] < least_words) | (counts["n_repeat_words"] > repeat_share * counts["n_words"])
                p = logistic(slope * raw_score(chunk, local) + shift)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0)[chunk.rows.start: chunk.rows.stop],
                    **{k: pa.array(counts[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
                    "base_failed": pa.array(failed), "probability": pa.array(p), "kept": pa.array(~failed & (p >= threshold))})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                               "base_failed boolean, probability double, kept boolean")
    return out.withColumnRenamed("id", id_col)
