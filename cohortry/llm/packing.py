"""Best-fit decreasing packing of tokenized documents into sequences of fixed length.

Tokenizing: a text is cut into units that the tokenizer splits at anyway (runs of Latin letters, single digits, runs of ASCII
punctuation; else everything between white space), and each task encodes a unit once. Longer documents are cut at the sequence
length, only those.

Packing: pieces are dealt to shards of about ``SHARD`` pieces by a hash of their place in the table. In a shard, pieces go by
decreasing length into the fullest sequence that has room, found with a segment tree over the remaining capacities. The pieces of all
sequences that are not full are then dealt anew and packed with those of other shards, in shards ``LARGER`` times as large, round after
round until they fit one shard or a round has hardly helped. So the number of sequences does not depend on the number of shards by more than a few.

Null text counts as empty: a document of its end token only. Rows that repeat an id are packed as rows of their own. An empty table
gives no rows. Columns other than id and text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm import words as W
from cohortry.llm.tables import stage

#: Pieces packed by one task.
SHARD = 100_000
#: The share of a sequence that counts as full, the share of pieces in others beyond which a round has hardly helped, and how many times
#: larger the shards of later rounds are.
FULL, STUCK, LARGER = 0.98, 0.9, 16
#: Units, and ids of units, that a task remembers; beyond that it begins anew.
REMEMBERED, REMEMBERED_IDS = 3_000_000, 24_000_000
#: Bits of a place in the table of units.
PLACES = 22

_LETTER, _DIGIT, _MARK, _SPACE, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[:128] = _MARK
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE


class Units:
    """Token ids of the units of texts. A unit is encoded when first seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.places = W.Places(PLACES)
        self.count = 0
        self.ids = W.Growing(np.uint16 if len(self.ends_word) <= 1 << 16 else np.uint32)
        self.at = W.Growing(np.int64)
        self.at.append(np.zeros(1, np.int64))

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.at.append(self.ids.size + np.cumsum(lengths))
        self.ids.append(ids)
        self.count += len(lengths)

    def learn(self, hashes: np.ndarray, texts: list[bytes], plain: np.ndarray) -> np.ndarray:
        """Encode unseen units; plain ones are single words for the tokenizer, so many are encoded as one text."""
        order = np.argsort(~plain, kind="stable")
        n, before = int(plain.sum()), self.count
        for begin in range(0, n, 2000):
            part = b" ".join(texts[i] for i in order[begin: min(begin + 2000, n)]).decode()
            ids = np.asarray(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != min(begin + 2000, n) - begin:
                raise AssertionError("a plain unit is not one word")
            self._add(ids, np.diff(ends, prepend=0))
        for i in order[n:]:
            ids = np.asarray(self.tokenizer.encode(texts[i].decode("utf-8", "replace"), add_special_tokens=False).ids, np.int64)
            self._add(ids, np.array([len(ids)]))
        numbers = np.empty(len(texts), np.int64)
        numbers[order] = np.arange(before, self.count)
        self.places.put(hashes, numbers)
        return numbers

    def encode(self, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows of a chunk, and where each row begins, with the end."""
        data = chunk.data
        if not len(chunk.starts):
            return np.zeros(0, np.uint32), np.zeros(len(chunk.rows) + 1, np.int64)
        kind = _KIND[data]
        lead = np.flatnonzero(data == 0xC3)  # letters from U+00C0 to U+00FF but for the signs in 0x97 and 0xB7
        lead = lead[lead + 1 < len(data)]
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        begins = np.ones(len(data) + 1, bool)
        begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[chunk.starts] = True
        strange = (kind == _OTHER) | (data == 0x27)  # an apostrophe may begin a contraction, <| a special token
        strange[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        apart = np.unique(np.searchsorted(chunk.starts, np.flatnonzero(strange), side="right") - 1)
        for s, e in zip(chunk.starts[apart], chunk.ends[apart], strict=True):
            begins[s + 1: e] = False
        solid = kind != _SPACE
        starts = np.flatnonzero(begins[:-1] & solid)
        solid[:-1] &= begins[1:-1] | (kind[1:] == _SPACE)
        ends = np.flatnonzero(solid) + 1
        hashes = chunk.span(chunk.prefix(True), starts, ends)
        plain = np.ones(len(starts), bool)
        if len(apart):  # case may matter to special tokens
            plain[apart := np.searchsorted(starts, chunk.starts[apart])] = False
            hashes[apart] = W.mix(chunk.span(chunk.prefix(), starts[apart], ends[apart]), 1)
        units = self.places.find(hashes)
        if len(missing := np.flatnonzero(units < 0)):
            if self.count + len(missing) > REMEMBERED or self.ids.size > REMEMBERED_IDS:
                self.forget()
                units = self.places.find(hashes)
                missing = np.arange(len(hashes))
            new, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            of = missing[first]
            units[missing] = self.learn(new, [data[s:e].tobytes() for s, e in zip(starts[of], ends[of], strict=True)], plain[of])[inverse]
        starts_of = self.at.used
        begin = starts_of[units]
        size = starts_of[units + 1] - begin
        at = np.zeros(len(units) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        ids = self.ids.used[np.arange(at[-1]) + np.repeat(begin - at[:-1], size)]
        return ids, at[np.searchsorted(starts, chunk.at)]


PIECES = "id long, piece int, start long, length long, ids_crc32 long, uid long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: id, piece, start, length, ids_crc32, uid (task and place in it), and ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(tokenizer)
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for chunk in W.chunks(batch.column(1)):
                ids, at = units.encode(chunk)
                rows = []
                for k, doc in enumerate(batch.column(0).slice(chunk.rows.start, len(chunk.rows)).to_pylist()):
                    own = np.append(ids[at[k]: at[k + 1]], np.uint32(end)).astype("<u4")
                    for n, start in enumerate(range(0, len(own), capacity)):
                        part = own[start: start + capacity]
                        rows.append((doc, n, start, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
                out = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(out, types)] + [pa.array(range(uid, uid + len(rows)), pa.int64())]
                uid += len(rows)
                names = ["id", "piece", "start", "length", "ids_crc32", "uid"]
                if with_ids:
                    columns.append(pa.array(out[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class OpenSequences:
    """Sequences by remaining capacity: a segment tree has, over each range of capacities, whether a sequence is open there."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.stacks[room].append(sequence)
        node, tree = room + self.size, self.tree
        while node and not tree[node]:
            tree[node] = 1
            node >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The open sequence with the least room that is enough, and its room; it is taken out."""
        node, tree, size = length + self.size, self.tree, self.size
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up to the nearest open range on the right
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - size
        sequence = self.stacks[room].pop()
        if not self.stacks[room]:
            tree[node] = 0
            node >>= 1
            while node and not (tree[2 * node] or tree[2 * node + 1]):
                tree[node] = 0
                node >>= 1
        return sequence, room


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length, taken in decreasing order, its sequence (from 0) and its offset there."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = OpenSequences(capacity)
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = opened.take(length)
        if found is None:
            number, room, count = count, capacity, count + 1
        else:
            number, room = found
        sequence[i], offset[i] = number, capacity - room
        if room > length:
            opened.put(room - length, number)
    return sequence, offset


def loose(sequence: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Whether each piece is in a sequence that is not full."""
    return (np.bincount(sequence, weights=lengths) < FULL * capacity)[sequence]


def packer(capacity: int, number: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one shard; in all rounds but the last, its loose sequences are marked for another."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = best_fit(lengths, capacity)
        again = np.zeros(len(pdf), bool) if last else loose(sequence, lengths, capacity)
        return pdf.assign(round=np.int32(number), sequence=sequence, offset=offset, again=again)

    return run


def assign(made: DataFrame, capacity: int) -> DataFrame:
    """``made`` (with ``uid`` and ``length``) with ``sequence_id`` and ``offset``."""
    rows = made.where(F.col("length") < capacity).select("uid", "length")
    left, before = rows.count(), None
    schema = "uid long, length long, shard int, round int, sequence long, offset long, again boolean"
    finished, number = [], 0
    while True:
        shards = max(1, -(-left // (LARGER * SHARD if number else SHARD)))
        # the number of a round has 4 bits
        last = shards == 1 or number == 15 or number > 1 and left > STUCK * before
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("uid", *[F.lit(number)] * (number > 0)), F.lit(shards)).cast("int"))
        packed = stage(dealt.groupBy("shard").applyInPandas(packer(capacity, number, last), schema), "packed")
        finished.append(packed.where("not again"))
        rows = packed.where("again").select("uid", "length")
        left, before, number = (0 if last else rows.count()), left, number + 1
        if not left:
            break
    placed = finished[0]
    for more in finished[1:]:
        placed = placed.unionByName(more)
    # round, shard and number in 4, 30 and 29 bits
    sequence_id = F.expr("shiftleft(cast(round as long), 59) + shiftleft(cast(shard as long), 29) + sequence")
    placed = placed.select("uid", sequence_id.alias("sequence_id"), "offset")
    whole = made.where(F.col("length") >= capacity).select("*", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return made.where(F.col("length") < capacity).join(placed, "uid").unionByName(whole)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    # written once, so the numbers hold
    made = stage(pieces(docs, tokenizer, capacity, end, id_col, text_col, with_ids), "pieces")
    return assign(made, capacity).drop("uid").withColumnRenamed("id", id_col)
