"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling, trained in numpy.

A word (a run of letters, lower-cased) has the sum of three rows of one hashed table: those of the word, of its first four and of its
first six bytes. Filters of one to three words run over the whole text; the largest value of each goes into a logistic output. Only rows
seen in training differ from zero, so unknown words say nothing. One coordinate begins at the smoothed log-odds of the row.

Learned are all labelled rows for which ``crc32(id as text) mod 5`` isn't 0 (``most``, if given, bounds the rows of each label), in shards
of some ``SHARD`` rows by the hash of their id. An epoch is a job: each shard descends from the same model, and what several shards have moved
is averaged, a row of the table over the shards that moved it. A quarter of the rows is kept out of the descent and
calibrates the score, so that 0.5 is the even point, and a threshold for each language: the one with the best F1 there, drawn to 0.5 by few
examples. Both come from counts of all those rows by score, in steps of 1/1,024 before calibration. Label, language, source and id are no inputs.

Null text is empty; texts without words get the score of an empty text. Rows with a null label teach nothing; if one label is missing, all
scores are the share of label 1. Rows that repeat an id are scored each; in learning they count once. A null or unknown language has
the threshold 0.5. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm import words as W
from cohortry.llm.quality import FEW, calibrate, logistic
from cohortry.llm.tables import fresh, stage
from cohortry.session import discard

BITS, DIM, FILTERS, WIDTHS = 18, 16, 8, (1, 2, 3)
PREFIXES = (4, 6)
PARTS = 1 + len(PREFIXES)
#: Words whose filters are held at once in learning, a longer text by itself.
SLICE = 1 << 16
#: Labelled rows of a shard in learning, steps of the score before calibration for one unit, and the largest such score told apart.
SHARD, STEPS, FAR = 4096, 1024, 32
#: Bits of the marks of labelled ids.
MARKS = 1 << 26


@dataclass
class Model:
    table: np.ndarray
    filters: dict[int, np.ndarray]
    shifts: dict[int, np.ndarray]
    output: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)


def word_rows(chunk: W.Chunk) -> np.ndarray:
    """The rows of the table for each word, ``(words, PARTS)``."""
    prefix = chunk.prefix(lower=True)
    mask = np.uint64((1 << BITS) - 1)
    out = np.empty((len(chunk.starts), PARTS), np.int32)
    out[:, 0] = chunk.span(prefix, chunk.starts, chunk.ends) & mask
    for k, n in enumerate(PREFIXES):
        out[:, k + 1] = W.mix(chunk.span(prefix, chunk.starts, np.minimum(chunk.starts + n, chunk.ends)), n) & mask
    return out


def filtered(model: Model, rows: np.ndarray, first: np.ndarray) -> dict[int, np.ndarray]:
    """For each width the values of its filters at all windows; windows over the end of a text have 0."""
    x = model.table[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        x = x + model.table[rows[:, k]]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = {}
    for width in WIDTHS:
        n = max(0, len(rows) - width + 1)
        z = np.zeros((len(rows), FILTERS), np.float32)
        if n:
            z[:n] = model.shifts[width]
            for o in range(width):
                z[:n] += x[o: o + n] @ model.filters[width][o]
            z[:n][text[:n] != text[width - 1: width - 1 + n]] = 0
            np.maximum(z, 0, out=z)
        out[width] = z
    return out


def pooled(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Largest value of each filter in each text, 0 where there are no words."""
    out = np.zeros((len(first) - 1, z.shape[1]), np.float32)
    worded = np.flatnonzero(np.diff(first))
    if len(worded):
        out[worded] = np.maximum.reduceat(z, first[worded], axis=0)
    return out


def forward(model: Model, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    values = filtered(model, rows, first)
    return np.concatenate([pooled(values[w], first) for w in WIDTHS], axis=1) @ model.output + model.bias


def among(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The ``rows`` whose id has its mark set by an id of ``known``: all that are in both, and a few others, the more the more ids there are.

    So nearly all texts without a label go where they are read. The marks are at most ``MARKS`` / 64 rows of two numbers, at any scale."""
    spot = F.xxhash64("id").bitwiseAND(F.lit(MARKS - 1))
    at, bit = F.shiftright(spot, 6), spot.bitwiseAND(F.lit(63)).cast("int")
    marks = known.select(at.alias("at"), bit.alias("bit")).groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mark"))
    met = rows.withColumns({"at": at, "bit": bit}).join(F.broadcast(marks), "at")
    return met.where(F.expr("shiftrightunsigned(mark, bit) & 1L = 1L")).select(*rows.columns)


def gather(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None, id_col: str, text_col: str, lang_col: str | None, label: str) -> DataFrame:
    """``(id, label, lang, text, aside, shard)`` of what is learned from, written in the order of hashes in each shard."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    if most:
        chosen = None
        for value, bound in most.items():
            some = known.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(bound)
            chosen = some if chosen is None else chosen.unionByName(some)
        known = chosen
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
    known = stage(known, "known")
    shards = max(1, -(-known.count() // SHARD))
    rows = among(rows.where(F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))), known)
    # labels and texts meet in their shard, so texts travel once; rows that repeat an id count once
    both = rows.unionByName(known, allowMissingColumns=True).repartition(shards, "id")
    rows = both.groupBy("id").agg(F.max("label").alias("label"), F.min(F.when(F.col("text").isNotNull(), F.struct("text", "lang"))).alias("row"))
    rows = rows.where("label is not null and row is not null").sortWithinPartitions(F.xxhash64("id"), "id")
    out = stage(rows.select("id", "label", "row.lang", "row.text", (F.pmod(F.xxhash64("id", F.lit(21)), F.lit(4)) == 0).alias("aside"),
                            F.spark_partition_id().alias("shard")), "labelled")
    discard(known.sparkSession, known)
    return out


def learned(rows: DataFrame) -> DataFrame:
    """The columns that learning reads."""
    return rows.select("shard", "label", "text")


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Shard, labels, word rows and text bounds of some rows at a time, from columns shard, label and text."""
    for batch in batches:
        shard, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        ends = np.append(np.flatnonzero(np.diff(shard)) + 1, len(shard))
        for begin_, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            for chunk in W.chunks(batch.column(2)[begin_:end], separator=W.NOT_LETTERS):
                yield int(shard[begin_]), y[begin_ + chunk.rows.start: begin_ + chunk.rows.stop], word_rows(chunk), chunk.first


def slices(first: np.ndarray, chosen: np.ndarray, most: int = SLICE) -> Iterator[np.ndarray]:
    """The chosen texts in order, as many at once as have ``most`` words together, one at least."""
    begin, words = 0, 0
    for k, n in enumerate((first[chosen + 1] - first[chosen]).tolist()):
        if words + n > most and k > begin:
            yield chosen[begin:k]
            begin, words = k, 0
        words += n
    if len(chosen) > begin:
        yield chosen[begin:]


def words_of(rows: np.ndarray, first: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of some texts, and where each begins, with the end."""
    at = np.concatenate([[0], np.cumsum(first[part + 1] - first[part])]).astype(np.int64)
    return rows[np.arange(at[-1]) + np.repeat(first[part] - at[:-1], np.diff(at))], at


def held_out(row_id: Column) -> Column:
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def seen_in(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each row of the table the texts of label 1 and of label 0 in which it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for _, y, own, first in pieces_of(batches):
            n = len(y)
            text = np.repeat(np.arange(n), np.diff(first))
            keys = np.unique((own.astype(np.int64) * n + text[:, None]).ravel())
            for value in (0, 1):
                counts[value] += np.bincount(keys[y[keys % n] == value] // n, minlength=1 << BITS)
        used = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[1][used]), pa.array(counts[0][used])], ["slot", "up", "down"])

    got = learned(rows).mapInArrow(run, "slot long, up long, down long").groupBy("slot").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).toArrow()
    up, down = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = got["slot"].to_numpy()
    up[at], down[at] = got["up"].to_numpy(), got["down"].to_numpy()
    return up, down


def begin(up: np.ndarray, down: np.ndarray, share: float, seed: int) -> Model:
    """Random filters and rows, and the log-odds of each row in the first coordinate; ``share`` is that of label 1."""
    rng = np.random.default_rng(seed)
    seen = np.flatnonzero(up + down)
    table = np.zeros((1 << BITS, DIM), np.float32)
    table[seen] = rng.normal(0, 0.05, (len(seen), DIM))
    odds = np.log((up + 4 * share) / (up + down + 4)) - np.log(share)
    table[seen, 0] = 0.5 * odds[seen]
    filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][:, 0, : FILTERS // 2] = 1.0
    return Model(table, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.full(FILTERS * len(WIDTHS), 0.1, np.float32), -1.0)


def winning(model: Model, rows: np.ndarray, first: np.ndarray, part: np.ndarray) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Pooled values of some texts by width, and the word rows of the windows that won, ``(text, filter, word of the window, PARTS)``."""
    pools, places = {w: [] for w in WIDTHS}, {w: [] for w in WIDTHS}
    for some in slices(first, part):
        own, at = words_of(rows, first, some)
        values = filtered(model, own, at)
        for w in WIDTHS:
            z = values[w]
            winners = np.zeros((len(some), FILTERS), np.int64)
            for k in np.flatnonzero(np.diff(at)):
                winners[k] = at[k] + z[at[k]: at[k + 1]].argmax(axis=0)
            pools[w].append(pooled(z, at))
            # a window over the end of its text has lost, or all are 0 and none has a gradient
            reach = np.minimum(winners[:, :, None] + np.arange(w), max(0, len(own) - 1))
            places[w].append(own[reach] if len(own) else np.zeros((len(some), FILTERS, w, PARTS), np.int32))
    return {w: np.concatenate(pools[w]) for w in WIDTHS}, {w: np.concatenate(places[w]) for w in WIDTHS}


class Descent:
    """A model on its way, and the sums of squares of Adagrad."""

    def __init__(self, model: Model):
        self.model = model
        self.table = np.full(len(model.table), 1e-2, np.float32)
        self.dense = np.full(len(self.values()), 1e-2, np.float32)

    def _parts(self) -> list[np.ndarray]:
        return [self.model.output, *[self.model.filters[w] for w in WIDTHS], *[self.model.shifts[w] for w in WIDTHS]]

    def values(self) -> np.ndarray:
        """All that is not in the table, as one array."""
        return np.concatenate([np.float32([self.model.bias]), *[x.ravel() for x in self._parts()]])

    def set_values(self, values: np.ndarray) -> None:
        self.model.bias, at = float(values[0]), 1
        for x in self._parts():
            x[...] = values[at: at + x.size].reshape(x.shape)
            at += x.size

    def copy(self) -> Descent:
        m = self.model
        out = Descent.__new__(Descent)
        out.model = Model(m.table.copy(), {w: x.copy() for w, x in m.filters.items()}, {w: x.copy() for w, x in m.shifts.items()}, m.output.copy(), m.bias)
        out.table, out.dense = self.table.copy(), self.dense.copy()
        return out

    def step(self, rows: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, part: np.ndarray, rate: float) -> None:
        """One step on the logistic loss of some texts. Only the windows that won the pooling have a gradient."""
        model = self.model
        pools, places = winning(model, rows, first, part)
        h = np.concatenate([pools[w] for w in WIDTHS], axis=1)
        error = ((logistic(h @ model.output + model.bias) - y[part]) * weight[part] / len(part)).astype(np.float32)
        back = error[:, None] * model.output[None, :]
        filters, shifts, touched, moves = [], [], [], []
        for n, w in enumerate(WIDTHS):
            d = back[:, n * FILTERS: (n + 1) * FILTERS] * (pools[w] > 0)
            grads = np.zeros_like(model.filters[w])
            text, one = np.nonzero(d)
            pull = d[text, one]
            for o in range(w if len(text) else 0):
                of = places[w][text, one, o]
                np.add.at(grads[o].T, one, pull[:, None] * model.table[of].sum(axis=1))
                touched.append(of.ravel())
                moves.append(np.repeat(pull[:, None] * model.filters[w][o][:, one].T, of.shape[1], axis=0))
            filters.append(grads.ravel())
            shifts.append(d.sum(axis=0))
        g = np.concatenate([np.float32([error.sum()]), h.T @ error, *filters, *shifts]).astype(np.float32)
        self.dense += g * g
        self.set_values(self.values() - np.float32(rate) * g / np.sqrt(self.dense))
        if touched:
            used, where = np.unique(np.concatenate(touched), return_inverse=True)
            g = np.zeros((len(used), DIM), np.float32)
            np.add.at(g, where, np.concatenate(moves))
            self.table[used] += (g * g).mean(axis=1)
            model.table[used] -= np.float32(rate) * g / np.sqrt(self.table[used])[:, None]

    def moved(self, start: Descent) -> pa.RecordBatch:
        """Rows ``(slot, v0, ..., memory)`` that differ from the start; the slots beyond the table hold what is not in it, a value each."""
        used = np.flatnonzero(self.table != start.table)
        dense = np.arange(len(self.dense))
        v = np.zeros((len(used) + len(dense), DIM), np.float32)
        v[: len(used)], v[len(used):, 0] = self.model.table[used], self.values()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([used, dense + len(self.table)])), *[pa.array(np.ascontiguousarray(v[:, k])) for k in range(DIM)],
                                           pa.array(np.concatenate([self.table[used], self.dense]))], ["slot", *_COLUMNS])

    def take(self, got: pa.Table) -> None:
        slot = got["slot"].to_numpy()
        inside = slot < len(self.table)
        for k in range(DIM):
            self.model.table[slot[inside], k] = got[_COLUMNS[k]].to_numpy()[inside]
        self.table[slot[inside]] = got["memory"].to_numpy()[inside]
        values = self.values()
        values[slot[~inside] - len(self.table)] = got["v0"].to_numpy()[~inside]
        self.set_values(values)
        self.dense[slot[~inside] - len(self.table)] = got["memory"].to_numpy()[~inside]


_COLUMNS = [*[f"v{k}" for k in range(DIM)], "memory"]


def descend(model: Model, rows: DataFrame, counts: dict[int, int], epochs: int, batch: int, rate: float, seed: int) -> None:
    """Adagrad on the logistic loss with both labels weighing the same, a job for each epoch."""
    now, total = Descent(model), sum(counts.values())
    weights = np.array([0.5 * total / max(1, counts[0]), 0.5 * total / max(1, counts[1])])
    for epoch in range(epochs):
        shared = rows.sparkSession.sparkContext.broadcast((vars(now.model), now.table, now.dense))  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], epoch: int = epoch, shared=shared) -> Iterator[pa.RecordBatch]:
            start = Descent.__new__(Descent)
            start.model, start.table, start.dense = Model(**shared.value[0]), shared.value[1], shared.value[2]
            own, at, rng = None, None, None
            for shard, y, words, first in pieces_of(batches):
                if shard != at:
                    if own:
                        yield own.moved(start)
                    own, at, rng = start.copy(), shard, np.random.default_rng((seed, epoch, shard))
                for part in np.array_split(rng.permutation(len(y)), max(1, round(len(y) / batch))):
                    own.step(words, first, y, weights[y], part, rate)
            if own:
                yield own.moved(start)

        moved = learned(rows).mapInArrow(run, "slot long, " + ", ".join(f"{c} float" for c in _COLUMNS))
        # at most one row for each row of the table reaches the driver
        now.take(moved.groupBy("slot").agg(*[F.avg(c).cast("float").alias(c) for c in _COLUMNS]).toArrow())
        shared.destroy()


def levels(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Languages, scores before calibration in steps, labels, and how many rows have them."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for chunk in W.chunks(batch.column(2), separator=W.NOT_LETTERS):
                z = forward(own, word_rows(chunk), chunk.first).astype(float)
                out[chunk.rows.start: chunk.rows.stop] = np.rint(np.clip(z, -FAR, FAR) * STEPS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["lang", "label", "step"])

    found = rows.select("lang", "label", "text").mapInArrow(run, "lang string, label int, step long").groupBy("lang", "label", "step").agg(F.count("*").alias("n"))
    # for each language and label as many rows as there are steps, at most
    got = found.toArrow().sort_by([("lang", "ascending"), ("step", "ascending"), ("label", "ascending")])
    return np.array(got["lang"].to_pylist(), object), got["step"].to_numpy() / STEPS, got["label"].to_numpy().astype(np.int64), got["n"].to_numpy()


def best_threshold(p: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, prior: float = 10.0) -> float:
    """The threshold with the best F1, drawn to 0.5 as if by ``prior`` examples of label 1; ``n``: how many rows each entry stands for."""
    n = np.ones(len(y), np.int64) if n is None else n
    up = (y * n).sum()
    if not up:
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((y * n)[order])
    f1 = 2 * hits / (np.cumsum(n[order]) + up)
    ends = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    below = p[order][k + 1] if k + 1 < len(p) else 0.0
    share = up / (up + prior)
    return float(share * (p[order][k] + below) / 2 + (1 - share) * 0.5)


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str | None = "lang", label: str = "toxic", epochs: int = 8, batch: int = 64, rate: float = 0.05, seed: int = 7) -> Model:
    """Learn from all labelled rows, or from at most ``most[0]`` and ``most[1]`` of either label if that is given."""
    rows = gather(docs, labels, most, id_col, text_col, lang_col, label)
    count = {(0, False): 0, (0, True): 0, (1, False): 0, (1, True): 0}
    count |= {(r["label"], r["aside"]): r["count"] for r in rows.groupBy("label", "aside").count().collect()}
    total = {y: count[y, False] + count[y, True] for y in (0, 1)}
    if not total[0] or not total[1]:
        n = total[0] + total[1]
        share = float(np.clip(total[1] / n, 1e-3, 1 - 1e-3)) if n else 1e-3
        empty = {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS}
        discard(rows.sparkSession, rows)
        return Model(np.zeros((1 << BITS, DIM), np.float32), empty, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
                     np.zeros(FILTERS * len(WIDTHS), np.float32), float(np.log(share / (1 - share))))
    apart = min(count[0, True], count[1, True]) >= FEW and count[0, False] and count[1, False]
    chosen, rest = (rows.where("not aside"), rows.where("aside")) if apart else (rows, rows)
    learn = {y: count[y, False] for y in (0, 1)} if apart else total
    model = begin(*seen_in(chosen), learn[1] / (learn[0] + learn[1]), seed)
    descend(model, chosen, learn, epochs, batch, rate, seed)
    langs, z, y, n = levels(rest, model)
    discard(rows.sparkSession, rows)
    model.slope, model.shift = calibrate(z, y, n)
    p = logistic(model.slope * z + model.shift)
    model.thresholds = {lang: best_threshold(p[langs == lang], y[langs == lang], n[langs == lang]) for lang in sorted(set(langs)) if lang}
    return model


def scores(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a score of its text; all columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # of fixed size
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for chunk in W.chunks(batch.column(at), separator=W.NOT_LETTERS):
                z = forward(own, word_rows(chunk), chunk.first)
                out[chunk.rows.start: chunk.rows.stop] = logistic(own.slope * z.astype(float) + own.shift)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def with_threshold(scored: DataFrame, model: Model, lang_col: str, score_col: str, out_col: str) -> DataFrame:
    """Adds whether the score reaches the threshold of the row's language."""
    threshold = F.lit(0.5)
    for lang, value in model.thresholds.items():
        threshold = F.when(F.col(lang_col) == lang, F.lit(value)).otherwise(threshold)
    return scored.withColumn(out_col, F.col(score_col) >= threshold)


def assess(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, score, predicted, toxic (by the threshold of its language)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang"))
    out = with_threshold(scores(rows, model), model, "lang", "score", "toxic")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that reach the threshold of their language."""
    score = fresh(docs, "score")
    scored = scores(docs, model, text_col, score)
    flag = fresh(scored, "toxic")
    return with_threshold(scored, model, lang_col, score, flag).where(~F.col(flag)).drop(score, flag)
