"""Exact set-similarity join of sets of word shingles, for documents and for lines.

An item is a document or one of its lines, its set the distinct hashes of its word windows. Equal sets are one node, named by a
64-bit digest of the set; shingles are 64-bit hashes. Two sets are similar if their Jaccard similarity is at least ``num / den``.

1. ``survey`` reads all texts once: the node and size of every item, and how often shingles fall into each of 65,536 ranges of
   their hash. The counts order shingles by rarity: a shingle's *token* is the rank of its range followed by the rest of its hash, so
   tokens compare by rarity and still tell all shingles apart. What many items share stands out in its range at every corpus size.
2. ``lists`` sends the tokens in the prefix of each set (which two similar sets must share a token of) to their index lists, with the
   size of the set and the position of the token. A task sends each node once, and tokens of crowded ranges are dealt to several places.
   Nearly all lists have one entry, so entries travel in blocks by part (a hash of the list), and each part, of a size that does not grow with the
   corpus, drops those.
3. ``near_pairs`` compares each entry with the head of its list and the entry before it only; ``verify`` counts the overlap on whole sets.
   So a crowd of similar sets costs a few pairs per entry, and its answers (a component, or that an earlier match is known)
   hold for all that remain.
4. ``other_pairs`` looks at all pairs of a list whose answer is still open. Lists are split into blocks by size, entries whose positions
   lie too far apart are skipped, and so are, in the join itself, entries whose signatures differ too much: a set's signature has the parity of its
   tokens at each of some bits, so two sets differ in at least as many tokens as their signatures in bits. The first token that similar
   sets share stands early enough in both to leave room for the others, so a pair that meets only further back is no row. For documents,
   ``next_pairs`` first joins components by a few more pairs per entry. ``derive`` then decides pairs from the overlap of a similar set where bounds are enough, and only the rest is verified.

Sets for verification are read again from the texts, for the nodes that pairs name: a bitmap of fixed size (``BITMAP`` bits) says
which; more nodes than it can tell apart make more sets travel, and change no result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm import words as W
from cohortry.llm.tables import stage

#: Ranges of hashes that are counted, the expected entries of a list above which it is dealt to places, and bits of the bitmap.
RANGES, CROWDED, BITMAP = 1 << 16, 20_000, 1 << 26
#: Entries of lists in a part, about, and those that a task gathers before it sends them.
PART, SENT = 1 << 18, 1 << 19
#: Where the place of a list is in its key, in bits.
PLACE_AT = 24
#: What the low bits of an item's id and number are multiplied by for its bit in the bitmap.
_LOW, _PLACE = (1 << 31) - 1, (1_000_003, 40_503_001)

#: Which of some items are looked at, by their row and number.
Wanted = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: From a text column to, for some rows at a time: their numbers, item numbers, words' hashes, and where each item's words begin.
Items = Callable[[pa.Array, Wanted | None], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def documents(column: pa.Array, wanted: Wanted | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each text is an item, number 0."""
    at = np.arange(len(column))
    if wanted:
        at = at[wanted(at, np.zeros(len(at), np.int64))]
        column = column.take(pa.array(at))
    for chunk in W.chunks(column):
        yield at[chunk.rows.start: chunk.rows.stop], np.zeros(len(chunk.rows), np.int64), chunk.names(), chunk.first


def lines(column: pa.Array, wanted: Wanted | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each line of each text is an item, numbered in its text from 0. Texts are split some at a time, as a batch may be large."""
    for begin, end in W.stretches(column):
        texts, row = W.lines(column[begin:end])
        number = np.arange(len(row)) - np.searchsorted(row, row)
        row = row + begin
        if wanted:
            at = np.flatnonzero(wanted(row, number))
            texts, row, number = texts.take(pa.array(at)), row[at], number[at]
        for chunk in W.chunks(texts):
            at = slice(chunk.rows.start, chunk.rows.stop)
            yield row[at], number[at], chunk.names(), chunk.first


#: Words of 64 bits in a signature, by kind of item: long sets need more bits to be told apart.
SIGNED = {documents: 4, lines: 2}


def signatures(values: np.ndarray, row: np.ndarray, n: int, words: int) -> list[np.ndarray]:
    """The parity of each item's hashes at each bit, ``words`` columns of 64, a power of two."""
    bounds = np.searchsorted(row, np.arange(n + 1))
    full = np.flatnonzero(np.diff(bounds))
    # hashes are spread evenly, so their low bits say which bit of which word
    place, bit = values >> np.uint64(6) & np.uint64(words - 1), np.uint64(1) << (values & np.uint64(63))
    out = []
    for k in range(words):
        own = np.zeros(n, np.uint64)
        if len(full):
            own[full] = np.bitwise_xor.reduceat(np.where(place == k, bit, np.uint64(0)), bounds[full])
        out.append(own.view(np.int64))
    return out


def marks(values: np.ndarray, row: np.ndarray, n: int) -> pa.ListArray:
    """Of each item the parity of its hashes at each of some bits, a power of two of at least its size and 64, in words of 64 bits."""
    size = np.bincount(row, minlength=n)
    words = 1 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(words)])
    bit = (W.mix(values, 18) & (64 * words - 1).astype(np.uint64)[row]).astype(np.int64)
    odd = (np.bincount(at[row] * 64 + bit, minlength=64 * at[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def digests(values: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digest of each item's set, whatever its order, and its size."""
    bounds = np.searchsorted(row, np.arange(n + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(values, 11), dtype=np.uint64)])
    size = np.diff(bounds)
    return W.mix((total[bounds[1:]] - total[bounds[:-1]]) ^ W.mix(size.astype(np.uint64), 12), 13).view(np.int64), size


def _place_of(tokens: np.ndarray, node: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Where an entry of a list that is dealt to places stands, -1 in others; ``places`` has their number by rank of the token's range."""
    spread = places[(tokens >> np.uint64(48)).astype(np.int64)]
    return np.where(spread > 1, (node.view(np.uint64) % spread.astype(np.uint64)).astype(np.int32), -1).astype(np.int32)


def _starts(*columns: np.ndarray) -> np.ndarray:
    return np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)) if len(columns[0]) else np.zeros(0, bool)


def _several(key: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which entries, sorted by key, are of a list with two or more, or of one that is dealt to places."""
    new = _starts(key)
    dealt = places[(key.view(np.uint64) >> np.uint64(48)).astype(np.int64)] > 1
    return np.flatnonzero(~(new & np.append(new[1:], True)) | dealt) if len(key) else np.zeros(0, np.int64)


def _entries(key: np.ndarray, node: np.ndarray, stands: np.ndarray, ord: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Whole lists, sorted by key: each node once, with the entry before it and the head of the list. Those with one node go, unless dealt to
    places. A set with few tokens of its own has a shared token early: the original of a crowd of near copies stands at the head."""

    some = _several(key, places)
    # tasks that sent the same node are merged
    some = some[np.lexsort((ord[some], node[some], key[some]))]
    some = some[_starts(key[some], node[some])]
    some = some[_several(key[some], places)]
    some = some[np.lexsort((node[some], ord[some], stands[some] & 0xFFFFFFFF, key[some]))]
    key, node, stands, ord = key[some], node[some], stands[some], ord[some]
    place = _place_of(key.view(np.uint64), node, places)
    size, pos = (stands >> 32).astype(np.int32), (stands & 0xFFFFFFFF).astype(np.int32)
    new, at = _starts(key), np.arange(len(key))
    head = np.maximum.accumulate(np.where(new, at, 0)) if len(key) else at

    def entry(of: np.ndarray, mask: np.ndarray | None = None) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(node[of]), pa.array(size[of]), pa.array(pos[of])], ["node", "size", "pos"], mask=None if mask is None else pa.array(mask))

    token = key ^ np.maximum(place, 0).astype(np.int64) << PLACE_AT
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(place), pa.array(node), pa.array(size), pa.array(pos), pa.array(ord), entry(np.maximum(at - 1, 0), new), entry(head)],
                                      ["token", "place", "node", "size", "pos", "ord", "before", "head"])


class Job:
    """One join: the table, its columns, what an item is, words per shingle, and the similarity ``num / den``."""

    def __init__(self, docs: DataFrame, items: Items, shingle: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text"):
        self.rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        self.items, self.shingle, self.num, self.den = items, shingle, num, den
        self.signed = [f"sign{k}" for k in range(SIGNED[items])]

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    # -- first reading ----------------------------------------------------------------------------------------------------------

    def survey(self, blank: bool = True, marked: bool = False) -> tuple[DataFrame, np.ndarray]:
        """Items ``(id, item, node, size, sign0, ...)``, without those that have no words if not ``blank``, and the rank of each range of hashes.
        ``marked`` adds ``marks``, for ``likely``."""
        items, shingle, signed = self.items, self.shingle, self.signed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(RANGES, np.int64)
            names = ["counts", "id", "item", "node", "size", *signed, *["marks"] * marked]
            for batch in batches:
                ids = batch.column(0)
                for rows, item, hashes, first in items(batch.column(1)):
                    values, row = W.distinct(*W.shingles(hashes, first, shingle))
                    counts += np.bincount((values >> np.uint64(48)).astype(np.int64), minlength=RANGES)
                    node, size = digests(values, row, len(rows))
                    at = np.arange(len(rows)) if blank else np.flatnonzero(size)
                    signs = (pa.array(s[at]) for s in signatures(values, row, len(rows), len(signed)))
                    more = [marks(values, row, len(rows)).take(pa.array(at))] if marked else []
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), bool)), ids.take(pa.array(rows[at])), pa.array(item[at]),
                                                      pa.array(node[at]), pa.array(size[at]), *signs, *more], names)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), bool)), pa.array(used, pa.int64()), pa.array(np.zeros(len(used), np.int64)),
                                              pa.array(np.zeros(len(used), np.int64)), pa.array(counts[used]), *[pa.array(np.zeros(len(used), np.int64))] * len(signed),
                                              *[pa.nulls(len(used), pa.list_(pa.int64()))] * marked], names)

        both = stage(self.rows.mapInArrow(run, "counts boolean, id long, item long, node long, size long" + "".join(f", {c} long" for c in signed) + ", marks array<long>" * marked), "survey")
        # at most one row for each range reaches the driver
        sums = both.where("counts").groupBy("id").agg(F.sum("size").alias("n")).toArrow()
        counts = np.zeros(RANGES, np.int64)
        counts[sums["id"].to_numpy()] = sums["n"].to_numpy()
        self.counts = counts
        rank = np.empty(RANGES, np.uint64)
        rank[np.argsort(counts, kind="stable")] = np.arange(RANGES, dtype=np.uint64)
        self.rank, self.back = rank, np.argsort(rank).astype(np.uint64)
        return both.where("not counts").drop("counts"), rank

    def tokens(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tokens of each item, rarest first."""
        values, row = W.shingles(hashes, first, self.shingle)
        return W.distinct(self.rank[(values >> np.uint64(48)).astype(np.int64)] << np.uint64(48) | values & np.uint64((1 << 48) - 1), row)

    def _node_of(self, tokens: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        values = self.back[(tokens >> np.uint64(48)).astype(np.int64)] << np.uint64(48) | tokens & np.uint64((1 << 48) - 1)
        return digests(values, row, n)

    # -- index lists --------------------------------------------------------------------------------------------------------------

    def lists(self) -> DataFrame:
        """Entries ``(token, place, node, size, pos, ord, head, before)`` of all lists with two nodes or more, or with places (from 0)."""
        job, num, den = _Light(self), self.num, self.den
        places = np.maximum(1, -(-self.counts // CROWDED))[np.argsort(self.rank)]  # by rank

        parts = int(-(-self.counts.sum() * (den - num) // (den * PART))) or 1

        def blocks(held: list[np.ndarray]) -> pa.RecordBatch:
            """Entries, columns of four numbers, as a row for each part."""
            entries = np.concatenate(held, axis=1)
            # numbers of two bytes are sorted in linear time
            part = (W.mix(entries[0].view(np.uint64), 19) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            entries = entries[:, order]
            full = np.flatnonzero(np.diff(cuts))
            made = [entries[:, cuts[k]: cuts[k + 1]].tobytes() for k in full.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(made, pa.binary())], ["part", "entries"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            held, n = [], 0
            for batch in batches:
                ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                for rows, _, hashes, first in job.items(batch.column(1)):
                    tokens, row = job.tokens(hashes, first)
                    node, size = job._node_of(tokens, row, len(rows))
                    names, at = np.unique(node, return_index=True)
                    names = names.tolist()
                    new = np.zeros(len(rows), bool)
                    new[at[[name not in seen for name in names]]] = True
                    seen.update(names)
                    bounds = np.searchsorted(row, np.arange(len(rows)))
                    pos = np.arange(len(row)) - bounds[row]
                    prefix = size - -(-size * num // den) + 1
                    keep = np.flatnonzero(new[row] & (pos < prefix[row]))
                    tokens, row, pos = tokens[keep], row[keep], pos[keep]
                    # a list's key is its token with the place in the middle bits, which say nothing of rarity
                    key = tokens ^ np.maximum(_place_of(tokens, node[row], places), 0).astype(np.uint64) << np.uint64(PLACE_AT)
                    held.append(np.stack([key.view(np.int64), node[row], size[row] << 32 | pos, ids[rows[row]]]))
                    n += len(key)
                    if n >= SENT:
                        yield blocks(held)
                        held, n = [], 0
            if n:
                yield blocks(held)

        def compare(part: pa.Table) -> pa.Table:
            entries = np.concatenate([np.frombuffer(b.as_buffer(), np.int64).reshape(4, -1) for b in part.column("entries")], axis=1)
            order = np.argsort(entries[0])
            key = entries[0][order]
            # nearly all lists have one entry: of the others alone the rest of the numbers is looked at
            return pa.Table.from_batches([_entries(*entries[:, order[_several(key, places)]], places)])

        # entries travel some hundreds to a row; a part holds whole lists, and there are as many parts as keep them small
        sent = self.rows.mapInArrow(run, "part int, entries binary")
        entry = "struct<node: long, size: int, pos: int>"
        made = sent.groupBy("part").applyInArrow(compare, f"token long, place int, node long, size int, pos int, ord long, before {entry}, head {entry}")
        return stage(made, "lists")

    def possible(self, a: str, b: str) -> Column:
        """Whether two entries of a list may be similar, by their sizes and positions."""
        most = 1 + F.least(F.expr(f"{a}size - 1 - {a}pos"), F.expr(f"{b}size - 1 - {b}pos"))
        return most * (self.num + self.den) >= self.num * (F.col(f"{a}size") + F.col(f"{b}size"))

    def prefix(self, size: Column) -> Column:
        """How many of its rarest tokens a set of this size sends to lists."""
        return size - F.ceil(size * self.num / self.den).cast("int") + 1

    def needed(self, a: str, b: str) -> Column:
        """How many tokens the prefixes of two similar sets share at least.

        Of the tokens common to both, those that are not in both prefixes come after the end of the prefix that ends first, so there
        are no more of them than what that set has beyond its prefix."""
        beyond = F.greatest(*[F.col(f"{p}size") - self.prefix(F.col(f"{p}size")) for p in (a, b)])
        return F.greatest(F.ceil((F.col(f"{a}size") + F.col(f"{b}size")) * self.num / (self.num + self.den)) - beyond, F.lit(1))

    def near_pairs(self, lists: DataFrame) -> DataFrame:
        """Pairs ``(x, y)`` of an entry with the head of its list and with the entry before it, if they meet in a good part of the lists
        in which similar sets would. The others are left to ``other_pairs``."""
        met = lists.where("before is not null").select("node", "size", "pos", F.explode(F.array_distinct(F.array("head", "before"))).alias("o"))
        met = met.select("node", "size", "pos", F.col("o.node").alias("o_node"), F.col("o.size").alias("o_size"), F.col("o.pos").alias("o_pos"))
        return self._pairs(met.where(self.possible("", "o_")), "", "o_", 2)

    def next_pairs(self, lists: DataFrame, state: DataFrame, is_open: Callable[[str, str], Column], reach: int = 3) -> DataFrame:
        """Possible pairs ``(x, y)`` of an entry with those up to ``reach`` before it, in an order of its own for each list, so that the lists of
        a set bring it together with different ones. ``state`` and ``is_open`` are as in ``other_pairs``."""
        entries = lists.select("token", "place", "node", "size", "pos").join(state, "node")
        columns = [c for c in entries.columns if c not in ("token", "place")]
        order = Window.partitionBy("token", "place").orderBy(F.floor(F.log(F.col("size").cast("double")) / math.log(self.den / self.num)), F.xxhash64("token", "node"), "node")
        entry = F.struct(*columns)
        earlier = entries.select(*[F.col(c).alias(f"s_{c}") for c in columns], F.array(*[F.lag(entry, k).over(order) for k in range(1, reach + 1)]).alias("earlier"))
        met = earlier.select("*", F.explode(F.filter("earlier", lambda e: e.isNotNull())).alias("l")).select("*", *[F.col(f"l.{c}").alias(f"l_{c}") for c in columns])
        met = met.where(self.possible("s_", "l_") & self.apart() & is_open("s_", "l_") & self.near_signatures())
        return met.select(F.least("s_node", "l_node").alias("x"), F.greatest("s_node", "l_node").alias("y")).distinct()

    def _pairs(self, met: DataFrame, a: str, b: str, part: int) -> DataFrame:
        """Pairs that meet in a ``part``-th of the needed lists or more."""
        pairs = met.select(F.least(f"{a}node", f"{b}node").alias("x"), F.greatest(f"{a}node", f"{b}node").alias("y"), self.needed(a, b).alias("needed"))
        counted = pairs.where("x < y").groupBy("x", "y", "needed").agg(F.count("*").alias("met"))
        return counted.where(F.col("met") * part >= F.col("needed")).select("x", "y")

    def other_pairs(self, lists: DataFrame, state: DataFrame, is_open: Callable[[str, str], Column]) -> DataFrame:
        """Pairs that meet in a list early enough to be similar, and for which ``is_open`` holds.

        ``state`` has columns by ``node``, its signature among them; ``is_open`` gets the prefixes under which those of either entry stand."""
        more = [c for c in state.columns if c != "node"]
        # both sides of the join are made of the same entries
        entries = stage(lists.select("token", "node", "size", "pos").join(state, "node"), "entries")
        # a little more than the sizes of similar sets may differ by, whatever rounding does
        ratio = math.log(self.den / self.num) * (1 + 1e-6)
        band = F.floor(F.log(F.col("size").cast("double")) / ratio).cast("int")
        # the first token of all that similar sets share leaves both of them room for the others: entries too far back for any partner
        # of their side go before the join
        room = (F.col("size") - F.col("pos")) * (self.num + self.den)
        first = room >= 2 * self.num * F.col("size")
        # a set's partners of no smaller size are in its own band of sizes or in the one above
        small = (entries.where(first).select("token", F.explode(F.array(band, band + 1)).alias("band"),
                                             *[F.col(c).alias(f"s_{c}") for c in ("node", "size", "pos", *more)]))
        most = F.greatest(F.floor(room / self.num) - F.col("size"), F.lit(1))
        top = F.least(band, F.floor(F.log(most.cast("double")) / ratio).cast("int") + 1)
        large = entries.where(top >= band - 1).select("token", band.alias("band"), *[F.col(c).alias(f"l_{c}") for c in ("node", "size", "pos", *more)])
        ordered = (F.col("s_size") < F.col("l_size")) | (F.col("s_size") == F.col("l_size")) & (F.col("s_node") < F.col("l_node"))
        alike = F.col("s_size") * self.den >= F.col("l_size") * self.num
        met = large.join(small, ["token", "band"]).where(ordered & alike & self.possible("s_", "l_") & self.apart() & is_open("s_", "l_") & self.near_signatures())
        return met.select(F.least("s_node", "l_node").alias("x"), F.greatest("s_node", "l_node").alias("y")).distinct()

    def apart(self) -> Column:
        """Whether the places of one token in two sets are as near as those in similar sets must be: what stands before it in one
        set and not in the other is at most what the sets may differ in."""
        common = F.ceil((F.col("s_size") + F.col("l_size")) * self.num / (self.num + self.den))
        return (F.col("l_pos") - F.col("s_pos") <= F.col("l_size") - common) & (F.col("s_pos") - F.col("l_pos") <= F.col("s_size") - common)

    def near_signatures(self) -> Column:
        """Whether two sets may be similar by their signatures. Each bit in which these differ is a token that only one of the sets has, so
        the sets share at most half of what their sizes exceed the number of such bits by."""
        differ = F.lit(0)
        for c in self.signed:
            differ = differ + F.bit_count(F.col(f"s_{c}").bitwiseXOR(F.col(f"l_{c}")))
        total = F.col("s_size") + F.col("l_size")
        return (total - differ) * (self.num + self.den) >= 2 * self.num * total

    def likely(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """``pairs`` without those that cannot be similar by the ``marks`` of ``nodes``: bits in the order of a set's size, where those of
        ``near_signatures`` are few. The marks of the set with more of them are folded; where that takes more than once, a pair stays."""
        x, y = (nodes.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("marks").alias(f"{n}_marks")) for n in ("x", "y"))
        both = pairs.join(x, "x").join(y, "y")
        both = both.withColumns({"low": F.least(F.size("x_marks"), F.size("y_marks")), "high": F.greatest(F.size("x_marks"), F.size("y_marks"))})
        differ = F.expr("aggregate(sequence(0, low - 1), 0, (n, i) -> n + bit_count(x_marks[i] ^ y_marks[i]"
                        " ^ coalesce(get(x_marks, i + low), 0L) ^ coalesce(get(y_marks, i + low), 0L)))")
        total = F.col("x_size") + F.col("y_size")
        return both.where((F.col("high") > 2 * F.col("low")) | ((total - differ) * (self.num + self.den) >= 2 * self.num * total)).select("x", "y")

    # -- verification ---------------------------------------------------------------------------------------------------------------

    def sets(self, nodes: DataFrame, at: tuple[str, str] | None = None) -> DataFrame:
        """The sets ``(node, tokens)`` of at least the given nodes; ``at`` names columns with the id and number of an item that has the set, if
        known, so that the words of other items are not looked at."""
        bits = BITMAP.bit_length() - 1
        if at:
            low = (F.coalesce(c, F.lit(0)).bitwiseAND(F.lit(_LOW)) * F.lit(m) for c, m in zip(at, _PLACE, strict=True))
            spot = sum(low, F.lit(0)).bitwiseAND(F.lit(BITMAP - 1))
        else:
            spot = F.shiftrightunsigned("node", 64 - bits)
        marks = nodes.select(spot.cast("long").alias("spot")).groupBy(F.shiftright("spot", 6).alias("at")).agg(
            F.expr("bit_or(shiftleft(1L, cast(spot & 63 as int)))").alias("mark"))
        # at most BITMAP / 64 rows reach the driver, 16 bytes each as columns (as rows of objects they would be 16 times that)
        got = marks.toArrow()
        bitmap = np.zeros(BITMAP // 64, np.uint64)
        bitmap[got["at"].to_numpy()] = got["mark"].to_numpy().view(np.uint64)
        shared = self.spark.sparkContext.broadcast(bitmap)
        job = _Light(self)

        def marked(spot: np.ndarray) -> np.ndarray:
            return (shared.value[spot >> 6] >> (spot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)

                def wanted(rows: np.ndarray, items: np.ndarray, ids: np.ndarray = ids) -> np.ndarray:
                    return marked((ids[rows] & _LOW) * _PLACE[0] + (items & _LOW) * _PLACE[1] & BITMAP - 1)

                for rows, _, hashes, first in job.items(batch.column(1), wanted if at else None):
                    tokens, row = job.tokens(hashes, first)
                    node, size = job._node_of(tokens, row, len(rows))
                    wanted_now = size > 0
                    if not at:
                        wanted_now &= marked((node.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
                    bounds = np.searchsorted(row, np.arange(len(rows) + 1))
                    names, sets = [], []
                    for k in np.flatnonzero(wanted_now).tolist():
                        if (name := int(node[k])) not in seen:
                            seen.add(name)
                            names.append(name)
                            sets.append(tokens[bounds[k]: bounds[k + 1]].tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])

        return stage(self.rows.mapInArrow(run, "node long, tokens binary").repartition("node").dropDuplicates(["node"]), "sets")

    def verify(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """``pairs`` with ``x_size, y_size, common, similar``; ``sets`` are read from the texts if not given."""
        num, den = self.num, self.den
        if sets is None:
            sets = self.sets(pairs.select(F.explode(F.array("x", "y")).alias("node")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                xs, ys = batch.column(2), batch.column(3)
                sizes, common = [], []
                for a, b in zip(xs, ys, strict=True):
                    a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                    both = np.concatenate([a, b])
                    both.sort()
                    sizes.append((len(a), len(b)))
                    common.append(int((both[1:] == both[:-1]).sum()))
                sizes, common = np.array(sizes, np.int64).reshape(-1, 2), np.array(common, np.int64)
                similar = den * common >= num * (sizes.sum(axis=1) - common)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes[:, 0]), pa.array(sizes[:, 1]), pa.array(common), pa.array(similar)],
                                                 ["x", "y", "x_size", "y_size", "common", "similar"])

        x, y = (sets.select(F.col("node").alias(n), F.col("tokens").alias(f"{n}_tokens")) for n in ("x", "y"))
        joined = pairs.join(x, "x").join(y, "y").select("x", "y", "x_tokens", "y_tokens")
        return stage(joined.mapInArrow(run, "x long, y long, x_size long, y_size long, common long, similar boolean"), "verified")

    def derive(self, pairs: DataFrame, known: DataFrame, sizes: DataFrame) -> DataFrame:
        """``pairs`` with ``similar`` true or false where it follows from a verified pair, else null.

        Let v be the verified match of x that shares most with it. What y shares with x differs from what it shares with v by at
        most the elements that x has and v lacks, or the reverse."""
        two = known.select("x", "y", "x_size", "y_size", "common").unionByName(known.select(
            F.col("y").alias("x"), F.col("x").alias("y"), F.col("y_size").alias("x_size"), F.col("x_size").alias("y_size"), "common"))
        matches = two.where((self.den * F.col("common")) >= self.num * (F.col("x_size") + F.col("y_size") - F.col("common")))
        via = matches.groupBy("x").agg(F.max(F.struct("common", F.col("y").alias("v"), F.col("y_size").alias("v_size"))).alias("m"), F.max("x_size").alias("x_size"))
        via = via.select("x", "m.v", (F.col("x_size") - F.col("m.common")).alias("gained"), (F.col("m.v_size") - F.col("m.common")).alias("lost"))
        shared = two.select(F.col("x").alias("v"), "y", F.col("common").alias("v_common"))
        size = sizes.select(F.col("node").alias("x"), F.col("size").alias("x_size")), sizes.select(F.col("node").alias("y"), F.col("size").alias("y_size"))
        joined = pairs.join(size[0], "x").join(size[1], "y").join(via, "x", "left").join(shared, ["v", "y"], "left")
        need = self.num * (F.col("x_size") + F.col("y_size"))
        answer = (F.when((F.col("v_common") + F.col("gained")) * (self.num + self.den) < need, F.lit(False))
                  .when((F.col("v_common") - F.col("lost")) * (self.num + self.den) >= need, F.lit(True)))
        return joined.select("x", "y", answer.alias("similar"))


class _Light:
    """What tasks need of a job."""

    def __init__(self, job: Job):
        self.items, self.shingle, self.rank, self.back = job.items, job.shingle, job.rank, job.back

    tokens = Job.tokens
    _node_of = Job._node_of


def components(edges: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """``(node, root)`` for every node of ``edges``: the smallest node that it can reach. Large-star and small-star steps, each a written
    table, until the edges no longer change; a node's neighbours are only ever reduced to their least."""
    now = stage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour goes to the least of a node's neighbourhood
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        low = now.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(low.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
