"""Exact k nearest donors and distance-weighted imputation (F5, D5, F10) from an index of boxes, without pairing all rows.

The index: donors with equal coordinates are cut to the first ``k`` by key (no other can be among the k nearest), and the rest is sorted
along a curve that keeps near places together. Runs of ``CUT`` blocks' donors are cut at medians of their widest coordinate, again and
again, to blocks of at most ``BLOCK_DONORS`` with the box they lie in; successive blocks make ``top`` ranges, each a folder of the written
index, never more than ``MOST_TOPS``. The boxes of the tops go to the driver, those of the
blocks stay in a table with a row per top.

A search, for receivers of different coordinates:

1. The tops' boxes and counts bound the distance of the k-th donor. The nearest top's blocks bound it further, and so do the donors of the
   nearest block.
2. Tops nearer than the bound are looked up, then their blocks nearer than the bound: these are visited.
3. Receivers meet blocks in groups that are dealt to copies of the block where very many come together, so a crowd anywhere is more groups.

Bounds come from counts, so they are finite as soon as there are k donors at all. A batch of receivers reads only the folders it visits.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.session import discard, released, stage

BLOCK_DONORS, CUT = 2048, 64
#: Donors of a top, and the most tops there are; beyond ``MOST_TOPS`` times that many donors tops have more blocks.
TOP_DONORS, MOST_TOPS = 1 << 18, 4096
#: Receivers compared with a block at once, and how many may come together before they are dealt to copies of the block.
BATCH, CROWD = 512, 1 << 14
#: Points of each coordinate's distribution that the curve is laid along.
STEPS = 256


def _matrix(lists) -> np.ndarray:
    return np.column_stack([np.asarray(v, dtype=float) for v in lists])


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d][:, None] - b[:, d]
        out += gap * gap
    return out


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of every point to the nearest and the farthest place of every box."""
    near, far = np.zeros((len(points), len(low))), np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        x = points[:, d][:, None]
        below, above = low[:, d] - x, x - high[:, d]
        gap = np.maximum(np.maximum(below, above), 0.0)
        near += gap * gap
        reach = np.maximum(np.abs(x - low[:, d]), np.abs(high[:, d] - x))
        far += reach * reach
    return near, far


def median_cuts(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in groups of at most ``size``, cut at the median of the widest coordinate until they are small enough."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        blocks = -(-len(rows) // size)
        if blocks <= 1:
            out.append(rows)
            continue
        widest = int(np.ptp(points[rows], axis=0).argmax())
        rows = rows[np.argsort(points[rows, widest], kind="stable")]
        at = blocks // 2 * size
        todo += [rows[at:], rows[:at]]
    return out


def count_bound(far: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """For each point the least farthest distance within which boxes hold k donors; infinite if all hold fewer."""
    order = np.argsort(far, axis=1)
    enough = np.cumsum(counts[order], axis=1) >= k
    first = enough.argmax(axis=1)
    rows = np.arange(len(far))
    return np.where(enough[rows, first], far[rows, order[rows, first]], np.inf)


def _slack(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + 1e-9)


def curve_place(values: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Places along a curve through all coordinates at once: the interleaved bits of their shares of the distribution."""
    bits = 62 // len(steps)
    out = np.zeros(len(values), np.int64)
    for d, at in enumerate(steps):
        share = np.interp(values[:, d], at, np.linspace(0, 1, len(at))) if len(at) > 1 else np.zeros(len(values))
        cell = np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)
        for b in range(bits):
            out |= ((cell >> b) & 1) << (b * len(steps) + d)
    return out


@dataclass
class Part:
    """The index over donors that know the same coordinates, for distances over ``dims`` of them.

    ``tops``: number, count and box per top. ``boxes``: ``top, m`` (sub, count and box of each block). ``blocks``: ``sub, dk, dv, d0, ...``
    (keys, values and coordinates of each block, by key), in a folder per ``top``.
    """

    dims: list[str]
    key_type: str
    tops: dict[str, list]
    boxes: DataFrame = field(repr=False)
    blocks: DataFrame = field(repr=False)

    def top_arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        t, d = self.tops, len(self.dims)
        return (np.array(t["top"], np.int64), np.array(t["n"], np.int64), np.array(t["low"], float).reshape(-1, d), np.array(t["high"], float).reshape(-1, d))


def build(donors: DataFrame, dims: Sequence[str], key: str, value: str, k: int = 10) -> Part:
    """Index the donors that know the value and all of ``dims``; they can be searched for up to ``k``."""
    dims = list(dims)
    position = Window.partitionBy(*dims).orderBy(key)
    known = donors.select(*dims, key, value).dropna(subset=[*dims, value])
    pool = stage(known.withColumn("_r", F.row_number().over(position)).filter(F.col("_r") <= k).drop("_r"), "donors")
    found = pool.agg(F.count("*").alias("n"), *[F.approx_percentile(F.col(c).cast("double"), [i / STEPS for i in range(STEPS + 1)], 10_000).alias(f"q{i}")
                                                for i, c in enumerate(dims)]).first()
    if not found["n"]:
        raise ValueError(f"no donor has a known {value}")
    steps = [np.unique(np.array(found[f"q{i}"], float)) for i in range(len(dims))]
    size, d = BLOCK_DONORS, len(dims)
    key_type = donors.schema[key].dataType.simpleString()

    @F.pandas_udf("long")
    def along(*columns: pd.Series) -> pd.Series:
        return pd.Series(curve_place(_matrix(columns), steps))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, sub = None, 0
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            while len(held) >= CUT * size:
                yield blocks_of(held.iloc[: CUT * size], sub)
                sub, held = sub + CUT, held.iloc[CUT * size:]
        if held is not None and len(held):
            yield blocks_of(held, sub)

    def blocks_of(rows: pd.DataFrame, sub: int) -> pd.DataFrame:
        out = []
        for n, of in enumerate(median_cuts(rows[dims].to_numpy(float), size)):
            part = rows.iloc[of].sort_values(key)
            x = [part[c].to_numpy(float) for c in dims]
            out.append((int(part["top"].iloc[0]), sub + n, len(part), [float(v.min()) for v in x], [float(v.max()) for v in x],
                        part[key].tolist(), part[value].to_numpy(float), *x))
        return pd.DataFrame(out, columns=["top", "sub", "n", "low", "high", "dk", "dv", *[f"d{i}" for i in range(d)]])

    tops = min(MOST_TOPS, max(1, math.ceil(found["n"] / TOP_DONORS)))
    ranged = pool.withColumn("z", along(*[F.col(c).cast("double") for c in dims])).repartitionByRange(tops, "z", key)
    ranged = ranged.withColumn("top", F.spark_partition_id()).sortWithinPartitions("z", key)
    schema = f"top int, sub int, n int, low array<double>, high array<double>, dk array<{key_type}>, dv array<double>"
    blocks = stage(ranged.mapInPandas(cut, schema + "".join(f", d{i} array<double>" for i in range(d))), "index", ["top"])
    discard(donors.sparkSession, pool)
    boxes = stage(blocks.groupBy("top").agg(F.sort_array(F.collect_list(F.struct("sub", "n", "low", "high"))).alias("m")), "boxes")
    return Part(dims, key_type, _tops(boxes), boxes, blocks)


def _tops(boxes: DataFrame) -> dict[str, list]:
    def edge(field_name: str, op: str) -> Column:
        widest = F.transform(F.get(F.col(f"m.{field_name}"), F.lit(0)), lambda _, i: op_of[op](F.transform(F.col(f"m.{field_name}"), lambda b: F.get(b, i))))
        return widest.alias(field_name)

    op_of = {"min": F.array_min, "max": F.array_max}
    count = F.aggregate("m.n", F.lit(0).cast("long"), lambda s, n: s + n).alias("n")
    rows = boxes.select("top", count, edge("low", "min"), edge("high", "max")).orderBy("top").collect()
    return {c: [r[c] if c in ("top", "n") else list(r[c]) for r in rows] for c in ("top", "n", "low", "high")}


def _meet(receivers: DataFrame, side: DataFrame, by: list[str], columns: list[str], extra: Sequence[str] = ()) -> DataFrame:
    """Groups of receivers beside the row of ``side`` that they are to meet: ``by..., r0, ..., extra, side...``.

    Where more than ``CROWD`` of them come together they are dealt to as many copies of that row as it takes. The partitions are as many
    as the session's shuffles have, since few bytes here can be much work.
    """
    parts = int(receivers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    crowded = receivers.groupBy(*by).count().filter(F.col("count") > CROWD).select(*by, F.ceil(F.col("count") / CROWD).cast("int").alias("_copies"))
    copies = F.coalesce("_copies", F.lit(1))
    dealt = receivers.join(crowded, by, "left").withColumn("_copy", F.pmod(F.xxhash64(*columns), copies).cast("int"))
    groups = dealt.repartition(parts, *by, "_copy").groupBy(*by, "_copy").agg(F.collect_list(F.struct(*columns, *extra)).alias("m"))
    groups = groups.select(*by, "_copy", *[F.col(f"m.{c}").alias(f"r{i}") for i, c in enumerate(columns)], *[F.col(f"m.{c}").alias(c) for c in extra])
    copied = side.join(crowded, by, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return groups.join(copied, [*by, "_copy"]).drop("_copy")


def _groups(batches: Iterator[pd.DataFrame], dims: int) -> Iterator[tuple]:
    """Each joined row, with its receivers in slices of bounded size."""
    for batch in batches:
        for row in batch.itertuples(index=False):
            at = _matrix([getattr(row, f"r{i}") for i in range(dims)])
            for start in range(0, len(at), BATCH):
                yield row, at[start: start + BATCH], slice(start, start + BATCH)


def _box_arrays(m) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (np.array([b["sub"] for b in m], np.int64), np.array([b["n"] for b in m], np.int64), np.array([b["low"] for b in m], float),
            np.array([b["high"] for b in m], float))


def visits(part: Part, receivers: DataFrame, k: int = 10) -> DataFrame:
    """``dims..., top, sub``: the blocks that may hold one of the k nearest donors of each position of ``receivers``."""
    dims, d = part.dims, len(part.dims)
    tops = part.top_arrays()
    names = ", ".join(f"`{c}` double" for c in dims)

    def frame(at: np.ndarray, **columns) -> pd.DataFrame:
        return pd.DataFrame(at, columns=dims).assign(**columns)

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BATCH):
                at = batch[dims].to_numpy(float)[start: start + BATCH]
                near, far = box_distances(at, *tops[2:])
                yield frame(at, top=tops[0][np.lexsort((far, near), axis=1)[:, 0]], bound=count_bound(far, tops[1], k))

    def nearest_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, at, rows in _groups(batches, d):
            sub, n, low, high = _box_arrays(row.m)
            near, far = box_distances(at, low, high)
            bound = np.minimum(np.asarray(row.bound, float)[rows], count_bound(far, n, k))
            yield frame(at, top=row.top, sub=sub[np.lexsort((far, near), axis=1)[:, 0]], bound=bound)

    def from_donors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, at, rows in _groups(batches, d):
            bound = np.asarray(row.bound, float)[rows]
            if len(row.d0) >= k:
                gaps = squared_distances(at, _matrix([getattr(row, f"d{i}") for i in range(d)]))
                bound = np.minimum(bound, np.partition(gaps, k - 1, axis=1)[:, k - 1])
            near, _ = box_distances(at, *tops[2:])
            who, top = np.nonzero(near <= _slack(bound)[:, None])
            yield frame(at[who], bound=bound[who], top=tops[0][top])

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, at, rows in _groups(batches, d):
            sub, _, low, high = _box_arrays(row.m)
            near, _ = box_distances(at, low, high)
            who, block = np.nonzero(near <= _slack(np.asarray(row.bound, float)[rows])[:, None])
            yield frame(at[who], top=row.top, sub=sub[block])

    points = receivers.select(*[F.col(c).cast("double").alias(c) for c in dims]).dropna().distinct()
    at_home = stage(points.mapInPandas(home, f"{names}, top int, bound double"), "home")
    at_block = stage(_meet(at_home, part.boxes, ["top"], dims, ["bound"]).mapInPandas(nearest_block, f"{names}, top int, sub int, bound double"), "block")
    reach = stage(_meet(at_block, _pruned(part, at_block).select("top", "sub", *[f"d{i}" for i in range(d)]), ["top", "sub"], dims, ["bound"]).mapInPandas(from_donors, f"{names}, bound double, top int"), "reach")
    out = stage(_meet(reach, part.boxes, ["top"], dims, ["bound"]).mapInPandas(within, f"{names}, top int, sub int"), "visits")
    for done in (at_home, at_block, reach):
        discard(receivers.sparkSession, done)
    return out


def _pruned(part: Part, met: DataFrame) -> DataFrame:
    """Blocks of only those folders whose tops are met; at most ``MOST_TOPS`` numbers."""
    if len(part.tops["top"]) == 1:
        return part.blocks
    return part.blocks.filter(F.col("top").isin([r["top"] for r in met.select("top").distinct().collect()]))


def search(part: Part, receivers: DataFrame, k: int = 10) -> DataFrame:
    """``(dims..., rank, d2, value)``: the k nearest donors of every distinct receiver position.

    Equal distances fall in key order. ``d2`` is the squared Euclidean distance.
    """
    dims, d = part.dims, len(part.dims)
    met = visits(part, receivers, k)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, at, _ in _groups(batches, d):
            gaps = squared_distances(at, _matrix([getattr(row, f"d{i}") for i in range(d)]))
            take = min(k, gaps.shape[1])
            kth = np.partition(gaps, take - 1, axis=1)[:, take - 1]
            who, donor = np.nonzero(gaps <= kth[:, None])
            near = gaps[who, donor]
            order = np.lexsort((donor, near, who))
            who, donor, near = who[order], donor[order], near[order]
            keep = np.arange(len(who)) - np.searchsorted(who, np.arange(len(at)))[who] < take
            out = pd.DataFrame(at[who[keep]], columns=dims)
            out["d2"] = near[keep]
            out["_dk"] = np.asarray(row.dk, dtype=object)[donor[keep]]
            out["value"] = np.asarray(row.dv, dtype=float)[donor[keep]]
            yield out

    blocks = _pruned(part, met).select("top", "sub", "dk", "dv", *[f"d{i}" for i in range(d)])
    found = _meet(met, blocks, ["top", "sub"], dims).mapInPandas(compare, ", ".join(f"`{c}` double" for c in dims) + f", d2 double, _dk {part.key_type}, value double")
    best = Window.partitionBy(*dims).orderBy("d2", "_dk")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*dims, "rank", "d2", "value")


def nearest(receivers: DataFrame, donors: DataFrame, coords: Sequence[str], key: str, value: str, k: int = 10) -> DataFrame:
    """``(coords..., rank, d2, value)``: the k nearest donors of every distinct receiver position, from an index made for it."""
    return search(build(donors, coords, key, value, k), receivers, k)


def weighted_mean(gap2: float = 1.0, upto: int | None = None) -> Column:
    """Mean of the donor values weighted by 1 / distance; ``gap2`` is the fixed part of the squared distance.

    A receiver lacks the value, so its missing flag differs from every donor's: that adds ``gap2`` (1 after
    scaling a 0/1 flag). Rescaling for missing coordinates cancels where all donors share it.
    """
    weight = 1 / F.sqrt(F.col("d2") + F.lit(gap2))
    if upto is not None:
        weight = F.when(F.col("rank") <= upto, weight)
    return F.sum(F.col("value") * weight) / F.sum(weight)


def _patterns(df: DataFrame, coords: Sequence[str]) -> list[list[str]]:
    """The sets of known coordinates that occur (at most two to the number of coordinates)."""
    flags = df.select(*[F.col(c).isNotNull().alias(f"k{i}") for i, c in enumerate(coords)]).distinct().collect() if coords else [()]
    return [[c for c, known in zip(coords, row) if known] for row in sorted(flags, reverse=True)]


def _with_pattern(df: DataFrame, coords: Sequence[str], known: Sequence[str]) -> DataFrame:
    for c in coords:
        df = df.filter(F.col(c).isNotNull() if c in known else F.col(c).isNull())
    return df


class DonorIndex:
    """Donors of a value with an index for each set of coordinates that receivers and donors share, made when first asked for."""

    def __init__(self, donors: DataFrame, coords: Sequence[str], key: str, value: str, k: int = 10):
        self.coords, self.key, self.value, self.k = list(coords), key, value, k
        self.donors = donors.select(key, *self.coords, value).filter(F.col(value).isNotNull())
        self.owned = _patterns(self.donors, self.coords)
        if not self.owned:
            raise ValueError(f"no donor has a known {value}")
        self.parts: dict[tuple[str, ...], Part] = {}

    def pool(self, theirs: Sequence[str]) -> DataFrame:
        """The donors that know just the coordinates ``theirs``."""
        return _with_pattern(self.donors, self.coords, theirs)

    def part(self, theirs: Sequence[str], dims: Sequence[str]) -> Part:
        name = ("+".join(theirs), "+".join(dims))
        if name not in self.parts or released(self.parts[name].blocks):
            self.parts[name] = build(self.pool(theirs), dims, self.key, self.value, self.k)
        return self.parts[name]

    def save(self, path: str, spark: SparkSession) -> None:
        """The donors, and the indexes for receivers that know all coordinates."""
        for theirs in self.owned:
            if theirs:
                self.part(theirs, theirs)
        self.donors.write.mode("overwrite").parquet(f"{path}/rows")
        small = {"coords": self.coords, "key": self.key, "value": self.value, "k": self.k, "owned": self.owned, "parts": []}
        for n, (name, part) in enumerate(self.parts.items()):
            part.blocks.write.mode("overwrite").partitionBy("top").parquet(f"{path}/blocks{n}")
            part.boxes.write.mode("overwrite").parquet(f"{path}/boxes{n}")
            small["parts"].append({"name": name, "dims": part.dims, "key_type": part.key_type})
        spark.createDataFrame([(json.dumps(small),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/index")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> DonorIndex:
        small = json.loads(spark.read.text(f"{path}/index").first()["value"])
        out = cls.__new__(cls)
        out.coords, out.key, out.value, out.k, out.owned = (small[c] for c in ("coords", "key", "value", "k", "owned"))
        out.donors, out.parts = spark.read.parquet(f"{path}/rows"), {}
        for n, p in enumerate(small["parts"]):
            boxes = spark.read.parquet(f"{path}/boxes{n}")
            out.parts[tuple(p["name"])] = Part(p["dims"], p["key_type"], _tops(boxes), boxes, spark.read.parquet(f"{path}/blocks{n}"))
        return out


def fill_missing(df: DataFrame, target: str, coords: Sequence[str], key: str, donors: DonorIndex | None = None, k: int = 10,
                 gap2: float = 1.0, written: bool = False) -> DataFrame:
    """fill NULLs of ``target`` from the nearest ``donors`` (default: the rows of ``df`` that have it).

    A distance is taken over the coordinates that both rows know, and scaled up by the share that they are of all (with the
    target and its flag), so every receiver is filled, whatever it lacks. Receivers and donors are dealt with by the set of
    coordinates they know. ``df`` is read several times and therefore staged, unless it is ``written``: a projection of a staged table.
    """
    coords = list(coords)
    df = df if written else stage(df, "filled")
    index = DonorIndex(df, coords, key, target, k) if donors is None else donors
    lacking = df.filter(F.col(target).isNull())
    out = df.filter(F.col(target).isNotNull())
    for known in _patterns(lacking, coords):
        mine = _with_pattern(lacking, coords, known)
        places = mine.select(*known).distinct() if known else mine.select(F.lit(0).alias("_one")).limit(1)
        parts = []
        for n, theirs in enumerate(index.owned):
            shared = [c for c in known if c in theirs]
            if shared:
                found = search(index.part(theirs, shared), places, k)
                met = places.join(found, shared)
            else:
                found = index.pool(theirs).orderBy(key).limit(k).select(F.lit(0.0).alias("d2"), F.row_number().over(Window.orderBy(key)).alias("rank"),
                                                                        F.col(target).cast("double").alias("value"))
                met = places.join(found, F.lit(True))
            scale = (len(coords) + 2) / (len(shared) + 1)
            parts.append(met.select(*places.columns, ((F.col("d2") + gap2) * scale).alias("d2"), F.lit(n).alias("_n"), "rank", "value"))
        best = parts[0]
        if len(parts) > 1:
            for more in parts[1:]:
                best = best.unionByName(more)
            order = Window.partitionBy(*places.columns).orderBy("d2", "_n", "rank")
            best = best.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
        fills = best.groupBy(*places.columns).agg(weighted_mean(0.0).alias("_fill"))
        joined = mine.drop(target).join(fills, known, "left") if known else mine.drop(target).join(fills.drop("_one"), F.lit(True), "left")
        out = out.unionByName(joined.withColumnRenamed("_fill", target).select(*df.columns))
    return out


def imputation_quality(df: DataFrame, target: str, coords: Sequence[str], key: str, ks: Sequence[int] = (1, 3, 5, 7, 10),
                       share: float = 0.1, seed: int = 42, gap2: float = 1.0) -> DataFrame:
    """Hide a share of the known values by hash, impute them for every k from one search, and compare."""
    known = stage(df.filter(F.col(target).isNotNull()).dropna(subset=list(coords)), "known")
    draw = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double")
    hidden = draw < share * 2.0**32
    masked, donors = known.filter(hidden), known.filter(~hidden)
    found = nearest(masked, donors, coords, key, target, max(ks))
    guesses = found.groupBy(*coords).agg(*[weighted_mean(gap2, k).alias(f"g{k}") for k in ks])
    pairs = masked.join(guesses, list(coords)).withColumn("y", F.col(target).cast("double"))
    tallied = pairs.select("y", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("g")) for k in ks])))
    gap = F.col("y") - F.col("g")
    scored = tallied.groupBy("k").agg(F.count("*").alias("n"), F.sum(gap * gap).alias("sse"), F.avg(F.abs(gap)).alias("mae"),
                                      F.var_pop("y").alias("v"))
    return scored.select("k", "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), "mae",
                         (1 - F.try_divide(F.col("sse"), F.col("v") * F.col("n"))).alias("r2"))
