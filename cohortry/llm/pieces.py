"""Sampled segmentation into SentencePiece pieces, reproducible by row key, with lossless decoding.

A text is written as SentencePiece does without normalization: a space in front, spaces as U+2581. Any way to cut it into pieces of the
vocabulary, or into byte pieces where a character is in none, is a path through a lattice; a path's probability is the product of
``(rank + OFFSET) ** -alpha`` of its pieces, rank being the place of the piece in the model. Forward filtering sums the weights of all
paths to each place; backward sampling draws, from the end, each last piece in proportion. The draws are functions of the row's key,
the seed and the place in the text, so a row gets the same pieces in any partitioning, and equal texts under different keys
get different ones. A vocabulary piece holds the space sign in front only, so words are independent; a word's lattice
is filtered once per task, and backward steps go over all words of a batch together.

Pieces that are runs of space signs are not used: several spaces are single ones in a row. A U+2581 of the text itself is written as
bytes, so that decoding gives back the very text. Decoding joins pieces and bytes and takes the front space off.

Null text has null pieces; empty text has none. Rows that repeat a key and text get equal pieces. A null key counts as 0. An empty table
gives no rows. Columns other than key and text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm import words as W

OFFSET = 10.0
#: Edges of lattices that a task remembers, and bits of a place in its tables of words and of beginnings of pieces.
REMEMBERED, PLACES, BUCKETS = 8_000_000, 21, 18
SPACE = "▁".encode()


class Pieces:
    """The vocabulary by hash of the bytes, and the bytes by id."""

    def __init__(self, model: str, alpha: float):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        n = p.get_piece_size()
        self.byte_id = np.full(256, -1, np.int32)
        texts, usable = [], []
        for i in range(n):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                texts.append(b"")
            else:
                texts.append(piece.replace("▁", " ").encode())
                if "▁" not in piece[1:]:
                    usable.append(i)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        weight = (np.arange(n) + OFFSET) ** -alpha
        self.byte_weight = weight[self.byte_id]
        # every beginning of a piece, whole pieces among them, so that a text is followed no further than some piece goes
        ids = np.array(usable, np.int64)
        size = self.at[ids + 1] - self.at[ids]
        self.longest = int(size.max())
        owner = np.repeat(np.arange(len(ids)), size)
        length = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + 1
        chunk = W.Chunk(range(0), self.bytes, np.zeros(1, np.int64))
        begin = self.at[ids[owner]]
        hashes, of = np.unique(chunk.span(chunk.prefix(), begin, begin + length), return_inverse=True)
        whole = length == size[owner]
        if len(np.unique(of[whole])) < len(ids):
            raise ValueError("two pieces share a hash")
        self.hashes = np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bucket = np.searchsorted(hashes, np.arange(1 << BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKETS)).astype(np.int32)
        self.ids = np.full(len(hashes), -1, np.int32)
        self.ids[of[whole]] = ids[owner[whole]]
        self.weights = np.where(self.ids >= 0, weight[self.ids], 0.0)
        self.longer = np.zeros(len(hashes), bool)
        self.longer[of[~whole]] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of beginnings of pieces, -1 for other bytes."""
        at = self.bucket[(hashes >> np.uint64(64 - BUCKETS)).astype(np.int64)]
        before = np.flatnonzero(self.hashes[at] < hashes)
        while len(before):
            at[before] += 1
            before = before[self.hashes[at[before]] < hashes[before]]
        return np.where((self.hashes[at] == hashes) & (at < len(self.ids)), at, -1)


class Lattices:
    """Filtered lattices of words: for every end in a word its incoming pieces with their share of the weight.

    A word is bytes that begin with a space; ends are numbered over all words. The edges of an end begin at ``edge_at``, heaviest first;
    ``share`` is their running share, so that a draw mostly ends at the first."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.words = W.Places(PLACES)
        self.ends = 1
        self.edge_at, self.share, self.step, self.piece = (W.Growing(t) for t in (np.int32, np.float64, np.uint8, np.int32))
        self.edge_at.append(np.zeros(1, np.int32))

    def learn(self, keys: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Filter the lattices of new words, all words together, one place after another; the numbers of their first ends. ``data`` has the
        words' bytes one after another."""
        p = self.pieces
        begin = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        last = (begin + sizes)[word]
        chunk = W.Chunk(range(0), data, np.zeros(1, np.int64))
        prefix = chunk.prefix()
        heads = np.append((data & 0xC0) != 0x80, True)
        first = np.flatnonzero(heads[:-1])
        starts, ends, found = [], [], []
        s, room, n = first, last[first] - first, 0
        while len(s):
            n += 1
            k = p.find(chunk.span(prefix, s, s + n))
            known = np.flatnonzero(k >= 0)
            s, room, k = s[known], room[known], k[known]
            hit = (p.ids[k] >= 0) & (heads[s + n] | (room == n))
            starts.append(s[hit])
            ends.append(s[hit] + n)
            found.append(k[hit])
            on = p.longer[k] & (room > n)
            s, room = s[on], room[on]
        s, e, k = (np.concatenate(x) for x in (starts, ends, found))
        ids, weights = p.ids[k], p.weights[k]
        # a character in no piece of its own is bytes, and so is a sign that stands for a space
        length = np.zeros(len(data), np.int64)
        length[first] = np.diff(np.append(first, len(data)))
        single = np.zeros(len(data), bool)
        single[s[e - s == length[s]]] = True
        sign = np.zeros(len(data), bool)
        three = np.flatnonzero((data[:-2] == SPACE[0]) & (data[1:-1] == SPACE[1]) & (data[2:] == SPACE[2])) if len(data) > 2 else np.zeros(0, np.int64)
        sign[three] = True
        bad = first[~single[first] | sign[first]]
        if len(three):
            touch = np.zeros(len(data) + 1, np.int64)
            for o in range(3):
                touch[three + o] = 1
            total = np.concatenate([[0], np.cumsum(touch[:-1])])
            ok = total[e] == total[s]
            s, e, ids, weights = s[ok], e[ok], ids[ok], weights[ok]
        if len(bad):
            extra = np.concatenate([np.arange(b, b + length[b]) for b in bad])
            s, e = np.concatenate([s, extra]), np.concatenate([e, extra + 1])
            ids = np.concatenate([ids, p.byte_id[data[extra]]])
            weights = np.concatenate([weights, p.byte_weight[data[extra]]])
        # forward filter: sums of weights, scaled per word where they get small
        # edges by end, longest first, in one number
        order = np.argsort(e * (p.longest + 1) + p.longest - (e - s))
        s, e, ids, weights = s[order], e[order], ids[order], weights[order]
        of = word[s]
        # ``total`` has a place before each byte and one at the end of each word
        total = np.zeros(len(data) + len(sizes), np.float64)
        total[begin + np.arange(len(sizes))] = 1.0
        tail, end = s + of, e + of
        # edges by the place of their end in the word; numbers of two bytes are sorted in linear time
        depth = e - begin[of]
        deep = int(sizes.max())
        turn = np.argsort(depth.astype(np.uint16 if deep < 1 << 16 else np.int64), kind="stable")
        cuts = np.searchsorted(depth[turn], np.arange(1, deep + 2))
        mass = np.zeros(len(s))
        for d in range(deep):
            now = turn[cuts[d]: cuts[d + 1]]
            if not len(now):
                continue
            mass[now] = total[tail[now]] * weights[now]
            np.add.at(total, end[now], mass[now])
            if d % 16 == 15:  # all that later places of longer words draw on, scaled by the same number
                longer = np.flatnonzero(sizes > d + 1)
                now = total[begin[longer] + d + 1 + longer]
                longer, now = longer[now > 0], now[now > 0]
                for back in range(min(p.longest, d + 1) + 1):
                    total[begin[longer] + d + 1 - back + longer] /= now
        # edges in order of their end, words after another, the heaviest first: that is mostly the longest, so few ends are sorted once more
        amiss = np.zeros(len(total), bool)
        amiss[end[1:][(end[1:] == end[:-1]) & (mass[1:] > mass[:-1])]] = True
        some = np.flatnonzero(amiss[end])
        order = np.arange(len(s))
        order[some] = some[np.lexsort((-mass[some], end[some]))]
        ids, mass, step = ids[order], mass[order], (e - s)[order]
        first_of = np.concatenate([[0], np.cumsum(np.bincount(end, minlength=len(total)))])
        share = _within(mass, first_of, end)
        self.edge_at.append(first_of[:-1] + self.share.size)
        self.share.append(share)
        self.step.append(step)
        self.piece.append(ids)
        numbers = begin + np.arange(len(sizes)) + self.ends
        self.words.put(keys, numbers)
        self.ends += len(total)
        return numbers


def _within(mass: np.ndarray, first_of: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Running share of each edge among those of its end; the last one has 1."""
    group = np.bincount(end, weights=mass, minlength=len(first_of) - 1)
    run = np.cumsum(mass / np.maximum(group[end], 1e-300))
    share = np.minimum(run - np.concatenate([[0.0], run])[first_of[end]], 1.0)
    share[first_of[end + 1] - 1] = 1.0
    return share


def draws(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Even numbers in [0, 1) by row key and place."""
    return (W.mix(key ^ W.mix(place.astype(np.uint64), 31), 32) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


class Sampler:
    def __init__(self, model: str, alpha: float, seed: int):
        self.pieces = Pieces(model, alpha)
        self.lattices = Lattices(self.pieces)
        self.seed = W.mix(np.array([seed], np.uint64), 30)[0]

    def encode(self, chunk: W.Chunk, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all rows of a chunk, and where each row begins, with the end."""
        empty = np.diff(chunk.at) == 0
        # a space in front of every text; words begin at spaces
        lengths = np.diff(chunk.at) + ~empty
        at = np.concatenate([[0], np.cumsum(lengths)])
        data = np.full(at[-1], 0x20, np.uint8)
        keep = np.ones(at[-1], bool)
        keep[at[:-1][~empty]] = False
        data[keep] = chunk.data
        starts = np.flatnonzero(data == 0x20)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(chunk.rows) + 1, np.int64)
        ends = np.append(starts[1:], len(data))
        row = np.searchsorted(at, starts, side="right") - 1
        text = W.Chunk(range(0), data, np.zeros(1, np.int64))
        hashes = text.span(text.prefix(), starts, ends)
        top = self.lattices.words.find(hashes)
        if len(missing := np.flatnonzero(top < 0)):
            if self.lattices.share.size > REMEMBERED:
                self.lattices.forget()
                missing = np.arange(len(hashes))
            new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            of = missing[first]
            sizes = ends[of] - starts[of]
            bytes_of = np.arange(sizes.sum()) + np.repeat(starts[of] - (np.cumsum(sizes) - sizes), sizes)
            top[missing] = self.lattices.learn(new, data[bytes_of], sizes)[inverse]
        lattices = self.lattices
        edge_at, share, step, piece = (x.used for x in (lattices.edge_at, lattices.share, lattices.step, lattices.piece))
        # backward sampling of all words together, from their ends
        key = W.mix(keys.astype(np.uint64) ^ self.seed, 33)[row]
        left = ends - starts
        alive = np.arange(len(starts))
        drawn = np.full(len(data) + 1, -1, np.int32)  # by the place where a piece ends
        while len(alive):
            end = top[alive] + left[alive]
            here = starts[alive] + left[alive]
            u = draws(key[alive], here - at[row[alive]])
            edge = edge_at[end]
            beyond = np.flatnonzero(u >= share[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[u[beyond] >= share[edge[beyond]]]
            drawn[here] = piece[edge]
            left[alive] -= step[edge]
            alive = alive[left[alive] > 0]
        place = np.flatnonzero(drawn >= 0)
        return drawn[place], np.searchsorted(place, at, side="right")

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of all rows, and where each begins, with the end."""
        p = self.pieces
        size = p.at[ids + 1] - p.at[ids]
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        data = p.bytes[np.arange(at[-1]) + np.repeat(p.at[ids] - at[:-1], size)]
        bounds = at[first]
        front = bounds[:-1][np.diff(first) > 0]
        keep = np.ones(len(data), bool)
        keep[front] = False
        return data[keep], bounds - np.concatenate([[0], np.cumsum(np.diff(first) > 0)])


def encode(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 1, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: key, pieces (array), n_pieces, pieces_crc32 (of little-endian 32-bit ids), lossless (decoded and compared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model, alpha, seed)
        for batch in batches:
            keys = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            for chunk in W.chunks(batch.column(1)):
                at = slice(chunk.rows.start, chunk.rows.stop)
                ids, first = sampler.encode(chunk, keys[at])
                back, bounds = sampler.decode(ids, first)
                n = len(chunk.rows)
                same = [bool(np.array_equal(back[bounds[k]: bounds[k + 1]], chunk.data[chunk.at[k]: chunk.at[k + 1]])) for k in range(n)]
                mask = null[at]
                ids = ids.astype("<i4")
                crc = pa.array([zlib.crc32(ids[first[k]: first[k + 1]].tobytes()) for k in range(n)], pa.int64(), mask=mask)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32), mask=np.append(mask, False)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at], lists, pa.array(np.diff(first), pa.int64(), mask=mask), crc, pa.array(same, mask=mask)],
                                                 ["key", "pieces", "n_pieces", "pieces_crc32", "lossless"])

    rows = docs.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "key long, pieces array<int>, n_pieces long, pieces_crc32 long, lossless boolean")
    return out.withColumnRenamed("key", key_col)


def decode(encoded: DataFrame, model: str, pieces_col: str = "pieces", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its pieces; all columns are kept. Null pieces give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(model, 1.0, 0)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(pieces_col))
            ids = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
            data, bounds = sampler.decode(ids, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            texts = [None if x is None else data[bounds[k]: bounds[k + 1]].tobytes().decode() for k, x in enumerate(column.value_lengths().to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    from pyspark.sql import types as T

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())]))
