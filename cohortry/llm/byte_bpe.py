"""Byte-level BPE by merge ranks: encoding as the rank file's own library does, and decoding.

A text is split by a pattern; each match is encoded alone. A match that is a token is that token. Otherwise its bytes are tokens and the
neighbouring pair of least rank, the leftmost of equals, is merged until no pair is a token. A segment tree over the places of the bytes
holds the least ``(rank, place)`` of the pairs that begin there; a merge takes the root, removes the pair of the right token, and sets those
of the merged token and of its left neighbour, three point updates of logarithmic cost. Trees of many short matches are rows of one
array and go through their merges together; a long match has a tree of its own, so its cost grows with its bytes times their logarithm.

Texts are cut into units at which the pattern splits anyway: white space with what follows it up to the next white space. A task encodes a
unit once and remembers units up to a bound on their number and on their ids; beyond that it begins anew.

Null text is empty and has no ids. Rows that repeat an id or a text are encoded each. Texts of any length are taken whole; a text
without white space is a single unit. An empty table gives no rows. Columns other than id and text play no part in ``digests``; ``encode``
and ``decode`` keep them all.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.llm import words as W

#: Units and ids that a task remembers, and bits of a place in its table of units.
REMEMBERED, REMEMBERED_IDS, PLACES = 2_000_000, 16_000_000, 21
#: Matches up to so many bytes share an array of trees, and the leaves of an array.
SHORT, LEAVES = 256, 1 << 21
NONE = np.int64(1) << 62

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that end a character which is white space for no pattern; last bytes of other white space are left out.
_SOLID = ~_SPACE
_SOLID[0x1C:0x20] = False
_SOLID[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Merges:
    """The ranks of tokens and of pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        sizes = np.array([len(t) for t in by_id])
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, ``NONE`` where the pair is no token or a side is absent (negative)."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def together(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Token ids of short matches, rows of ``data`` of at least two bytes; -1 in places without a token."""
        count, width = data.shape
        bits = max(1, (width - 2).bit_length())
        leaves = 1 << bits
        place = np.arange(width)
        token = np.where(place < sizes[:, None], self.single[data], -1)
        right = np.where(place + 1 < sizes[:, None], place + 1, -1)
        left = np.broadcast_to(place - 1, data.shape).copy()
        tree = np.full((count, 2 * leaves), NONE, np.int64)

        def leaf(rank: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.where(rank == NONE, NONE, (rank << bits) | at)

        tree[:, leaves: leaves + width - 1] = leaf(self.pair(token[:, :-1], token[:, 1:]), place[:-1])
        for node in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + leaves
            tree[rows, node] = value
            while node[0] > 1:  # all leaves are equally deep
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.arange(count)
        while True:
            top = tree[rows, 1]
            rows, top = rows[top < NONE], top[top < NONE]
            if not len(rows):
                return token
            at = top & (leaves - 1)
            new = top >> bits
            gone = right[rows, at]
            after = right[rows, gone]
            token[rows, at], token[rows, gone], right[rows, at] = new, -1, after
            follows = after >= 0
            left[rows[follows], after[follows]] = at[follows]
            pair_leaf = gone < leaves  # the last byte begins no pair, and may have no leaf
            if pair_leaf.any():
                put(rows[pair_leaf], gone[pair_leaf], np.full(int(pair_leaf.sum()), NONE))
            put(rows, at, leaf(self.pair(new, np.where(follows, token[rows, after], -1)), at))
            before = left[rows, at]
            has = before >= 0
            if has.any():
                b, r = before[has], rows[has]
                put(r, b, leaf(self.pair(token[r, b], new[has]), b))

    def alone(self, piece: bytes) -> np.ndarray:
        """Token ids of one long match."""
        n = len(piece)
        bits = (n - 1).bit_length()
        leaves = 1 << bits
        start = self.single[np.frombuffer(piece, np.uint8)]
        full = np.full(2 * leaves, NONE, np.int64)
        rank = self.pair(start[:-1], start[1:])
        full[leaves: leaves + n - 1] = np.where(rank == NONE, NONE, (rank << bits) | np.arange(n - 1))
        size = leaves
        while size > 1:
            full[size // 2: size] = full[size: 2 * size].reshape(-1, 2).min(axis=1)
            size //= 2
        tree, token = array("q", full.tobytes()), array("q", start.tobytes())
        right = array("q", np.append(np.arange(1, n), -1).astype(np.int64).tobytes())
        left = array("q", np.arange(-1, n - 1).astype(np.int64).tobytes())
        none, pairs, mask = int(NONE), self.pairs, leaves - 1

        def put(at: int, value: int) -> None:
            node = at + leaves
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                value = other if other < value else value
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        def leaf(a: int, b: int, at: int) -> int:
            found = pairs.get(a << 32 | b)
            return none if found is None else found << bits | at

        while (top := tree[1]) != none:
            at, new = top & mask, top >> bits
            gone = right[at]
            after, before = right[gone], left[at]
            token[at], token[gone], right[at] = new, -1, after
            put(gone, none)
            if after >= 0:
                left[after] = at
                put(at, leaf(new, token[after], at))
            else:
                put(at, none)
            if before >= 0:
                put(before, leaf(token[before], new, before))
        out = np.frombuffer(token, np.int64)
        return out[out >= 0]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        known = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        counts = np.ones(len(pieces), np.int64)
        rest = np.flatnonzero(known < 0)
        sizes = np.array([len(pieces[i]) for i in rest], np.int64)
        short, of_short = rest[sizes <= SHORT], sizes[sizes <= SHORT]
        data = np.frombuffer(b"".join([pieces[i] for i in short]) + bytes(SHORT), np.uint8)
        begin = np.cumsum(of_short) - of_short
        done: list[tuple[np.ndarray, np.ndarray]] = []
        high = 2
        while high <= SHORT:
            of = np.flatnonzero((of_short <= high) & (of_short > (high // 2 if high > 2 else 0)))
            for part in np.split(of, range(LEAVES // high, len(of), LEAVES // high)):
                token = self.together(data[begin[part][:, None] + np.arange(high)], of_short[part])
                held = token >= 0
                counts[short[part]] = held.sum(axis=1)
                done.append((short[part], token[held]))
            high *= 2
        for i in rest[sizes > SHORT].tolist():
            ids = self.alone(pieces[i])
            counts[i] = len(ids)
            done.append((np.array([i]), ids))
        at = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        out[at[known >= 0]] = known[known >= 0]
        for of, ids in done:
            size = counts[of]
            out[np.arange(len(ids)) + np.repeat(at[of] - (np.cumsum(size) - size), size)] = ids
        return out, counts


class Encoder:
    """Ids of whole texts. ``pattern`` must split before white space that follows a character of another kind."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.merges = Merges(read_ranks(path))
        self.find = regex.compile(pattern).findall
        decimal = [str(i).encode() + b" " for i in range(len(self.merges.at) - 1)]
        self.decimal_at = np.concatenate([[0], np.cumsum([len(d) for d in decimal])]).astype(np.int64)
        self.decimal = np.frombuffer(b"".join(decimal), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.places = W.Places(PLACES)
        self.count = 0
        self.ids, self.at = W.Growing(np.int32), W.Growing(np.int64)
        self.at.append(np.zeros(1, np.int64))

    def learn(self, hashes: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Encode units; their numbers."""
        numbers: dict[str, int] = {}
        of, counts = [], np.zeros(len(texts), np.int64)
        find, number = self.find, numbers.setdefault
        for k, text in enumerate(texts):
            found = find(text.decode("utf-8", "replace"))
            counts[k] = len(found)
            for piece in found:
                of.append(number(piece, len(numbers)))
        ids, sizes = self.merges.encode([piece.encode() for piece in numbers])
        begin = np.concatenate([[0], np.cumsum(sizes)])
        of = np.array(of, np.int64)
        out, ends = _gather(ids, begin, of)
        unit_ends = ends[np.cumsum(counts)]
        self.at.append(self.ids.size + unit_ends)
        self.ids.append(out)
        made = np.arange(self.count, self.count + len(texts))
        self.count += len(texts)
        self.places.put(hashes, made)
        return made

    def encode(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows of a chunk, and where each row begins, with the end."""
        data = chunk.data
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(chunk.rows) + 1, np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = _SPACE[data[1:]] & _SOLID[data[:-1]]
        begins[chunk.at] = True
        begins[-1] = False
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        hashes = chunk.span(chunk.prefix(), starts, ends)
        units = self.places.find(hashes)
        if len(missing := np.flatnonzero(units < 0)):
            if self.count + len(missing) > REMEMBERED or self.ids.size > REMEMBERED_IDS:
                self.forget()
                missing = np.arange(len(hashes))
            new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            of = missing[first]
            units[missing] = self.learn(new, [data[s:e].tobytes() for s, e in zip(starts[of], ends[of], strict=True)])[inverse]
        ids, at = _gather(self.ids.used, self.at.used, units)
        return ids, at[np.searchsorted(starts, chunk.at)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows' ids, and where each row begins, with the end."""
        data, at = _gather(self.merges.bytes, self.merges.at, ids)
        return data, at[first]

    def written(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids as decimal numbers with a space after each, and where each row begins, with the end."""
        data, at = _gather(self.decimal, self.decimal_at, ids)
        return data, at[first]


def _gather(values: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values[at[k]: at[k + 1]]`` for each k of ``of``, one after another, and where each begins, with the end."""
    begin = at[of]
    size = at[of + 1] - begin
    ends = np.zeros(len(of) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return values[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)], ends


def digests(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256 (of the decoded bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                ids, first = encoder.encode(chunk)
                n = len(chunk.rows)
                text, at = encoder.written(ids, first)
                shas = [hashlib.sha256(text[at[k]: max(at[k], at[k + 1] - 1)]).hexdigest() for k in range(n)]
                del text
                back, at = encoder.decode(ids, first)
                decoded = [hashlib.sha256(back[at[k]: at[k + 1]]).hexdigest() for k in range(n)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[chunk.rows.start: chunk.rows.stop], pa.array(np.diff(first), pa.int64()),
                                                  pa.array(shas, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of its text; all columns are kept. A null text has null ids."""
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            column = batch.column(at_text)
            null = column.is_null().to_numpy(zero_copy_only=False)
            for chunk in W.chunks(column):
                ids, first = encoder.encode(chunk)
                rows = slice(chunk.rows.start, chunk.rows.stop)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32), mask=np.append(null[rows], False)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c[rows] for c in batch.columns), lists], [*batch.schema.names, ids_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for; all columns are kept. Null ids have null bytes."""
    at_ids = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks, pattern)
        for batch in batches:
            column = batch.column(at_ids)
            null = column.is_null().to_numpy(zero_copy_only=False)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            data, at = encoder.decode(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), first)
            out = [None if null[k] else data[at[k]: at[k + 1]].tobytes() for k in range(len(sizes))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, bytes_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(bytes_col, T.BinaryType())]))
