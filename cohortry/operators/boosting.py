"""Class-weighted, monotone-constrained boosted trees as Spark jobs (M1-M3, M8, M9).

The training table is binned once and staged as a short byte string per row, a byte per numeric feature and one per category. A fit whose
rows one task may hold grows its trees in one task; many of them, as in a search, are as many tasks. Such a task gets rows with equal bytes
and label as one, with the hashes by which they are drawn. Beyond that every tree level is one job for all fits: tasks add up gradients per (fit, node, byte) over their blocks, Spark sums those and chooses the split of each node where the
sums are, and one row per node comes to the driver; while the sums of all tasks are a few megabytes, the driver adds them itself. Margins stay beside the rows in blocks that Spark holds, and are written to the
shared folder every ``WRITE_EVERY`` trees, so that a lost executor costs a few trees of work. Both ways give the same trees.

Blocks are kept as an RDD: they are numpy arrays that change from tree to tree, which no column expression can hold.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cohortry.operators import metrics, trees
from cohortry.operators.trees import BoostParams, Draws, Layout, Node, Tree
from cohortry.session import discard, folder, stage

__all__ = ["BoostParams", "BoostedModel", "BinnedTable", "Node", "bin_table", "fit", "fit_many", "validate"]

TREE_COLUMNS = "tree int, node int, feature string, cut double, bin int, value double, gain double, cover double"
#: Rows and bytes that a single task may hold, and rows of a block where many tasks hold a table.
BLOCK_ROWS, BLOCK_BYTES, PART_ROWS = 1 << 22, 1 << 27, 1 << 16
#: Sums of all tasks of a level that may come to the driver.
DRIVER_BYTES = 1 << 24
#: Trees after which margins are written.
WRITE_EVERY = 25


@dataclass
class BoostedModel:
    features: list[str]
    trees: list[dict[int, Node]]
    base_margin: float

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as rows, one per node."""
        rows = [(t, i, self.features[n.feature] if n.feature >= 0 else None, float(n.cut), int(n.bin), float(n.value),
                 float(n.gain), float(n.cover)) for t, tree in enumerate(self.trees) for i, n in tree.items()]
        return spark.createDataFrame(rows, TREE_COLUMNS)

    def save(self, path: str, spark: SparkSession) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        head = spark.createDataFrame([(self.base_margin, self.features)], "base_margin double, features array<string>")
        head.coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> BoostedModel:
        head = spark.read.parquet(f"{path}/head").first()
        features = list(head["features"])
        trees: dict[int, dict[int, Node]] = {}
        for r in spark.read.parquet(f"{path}/trees").orderBy("tree", "node").collect():
            which = features.index(r["feature"]) if r["feature"] is not None else -1
            trees.setdefault(r["tree"], {})[r["node"]] = Node(r["value"], r["cover"], which, r["bin"], r["cut"], r["gain"])
        return cls(features, [trees[t] for t in sorted(trees)], head["base_margin"])


def positive_weight(df: DataFrame, label: str) -> float:
    """M1: negatives per positive; an error without positives."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    if not row["p"]:
        raise ValueError("no positive rows in the training data")
    return row["n"] / row["p"]


def monotone_by_name(features: Sequence[str], rising: Sequence[str] = ("numerical__age", "numerical__avg_glucose_level"),
                     falling: Sequence[str] = ()) -> dict[str, int]:
    """M2: +1, -1 or 0 per feature."""
    return {f: 1 if f in rising else -1 if f in falling else 0 for f in features}


@dataclass
class BinnedTable:
    """Staged rows ``key, h, y, keep..., b`` and where the features stand in the bytes ``b``."""

    rows: DataFrame
    layout: Layout

    @property
    def features(self) -> list[str]:
        return self.layout.features

    @property
    def cuts(self) -> list[np.ndarray]:
        return self.layout.cuts


def _layout(features: list[str], cuts: list[np.ndarray], bundles: Sequence[Sequence[str]]) -> Layout:
    """A column for each feature outside the bundles, and one for every 255 features of a bundle that have a cut."""
    column, code, sizes = np.full(len(features), -1), np.full(len(features), -1), []
    number = {f: i for i, f in enumerate(features)}
    bundled = {number[f]: (n, k) for n, bundle in enumerate(bundles) for k, f in enumerate(bundle)}
    of_bundle: dict[tuple[int, int], int] = {}
    for i, cut in enumerate(cuts):
        if i in bundled:
            place = bundled[i][0], bundled[i][1] // 255
            if place not in of_bundle:
                of_bundle[place] = len(sizes)
                sizes.append(1)
            column[i], code[i] = of_bundle[place], bundled[i][1] % 255 + 1
            sizes[column[i]] = max(sizes[column[i]], code[i] + 1)
        else:
            column[i] = len(sizes)
            sizes.append(len(cut) + 1)
    return Layout(features, cuts, column, code, sizes)


def bin_table(df: DataFrame, features: Sequence[str], label: str, key: str, max_bins: int = 64, keep: Sequence[str] = (),
              fit_on: Column | None = None, bundles: Sequence[Sequence[str]] = ()) -> BinnedTable:
    """Bin every feature at its quantiles (of the rows where ``fit_on`` holds) and stage ``key, h, y, keep..., b``.

    Rows go left at cut c when x < c; a bin is the number of cuts not above x, in one byte. Features of a bundle are 0 or 1, and at most
    one of them is 1 in a row; they share a byte.
    """
    features = list(features)
    if not 2 <= max_bins <= 256:
        raise ValueError("max_bins must lie between 2 and 256")
    number = {f: i for i, f in enumerate(features)}
    single = [i for i, f in enumerate(features) if not any(f in b for b in bundles)]
    source = df if fit_on is None else df.filter(fit_on)
    probs = [i / max_bins for i in range(max_bins + 1)]
    found = source.agg(F.count("*").alias("n"), *[F.approx_percentile(F.col(features[i]).cast("double"), probs, 10_000).alias(f"q{i}") for i in single],
                       *[F.max(F.col(f).cast("double")).alias(f"m{number[f]}") for b in bundles for f in b]).first()
    cuts = [np.unique(np.array(found[f"q{i}"], dtype=float))[1:] if i in set(single)
            else np.array([1.0] if found[f"m{i}"] == 1.0 else []) for i in range(len(features))]
    layout = _layout(features, cuts, bundles)
    columns: list[Column] = [F.lit(0)] * layout.width
    for c in range(layout.width):
        members = np.flatnonzero(layout.column == c).tolist()
        if layout.code[members[0]] < 0:
            columns[c] = F.col(features[members[0]]).cast("double")
        else:  # the sum of the codes of the features that are 1, as at most one is
            columns[c] = sum((F.col(features[i]).cast("double") * int(layout.code[i]) for i in members), F.lit(0.0))
    ready = df.select(F.col(key), F.xxhash64(key).alias("h"), F.col(label).cast("double").alias("y"), *keep, F.array(*columns).alias("x"))
    edges = [cuts[np.flatnonzero(layout.column == c)[0]] if layout.code[np.flatnonzero(layout.column == c)[0]] < 0 else None for c in range(layout.width)]

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("x")
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            bins = np.empty(x.shape, np.uint8)
            for c, cut in enumerate(edges):
                bins[:, c] = x[:, c] if cut is None else np.searchsorted(cut, x[:, c], side="right")
            packed = pa.Array.from_buffers(pa.binary(bins.shape[1]), len(bins), [None, pa.py_buffer(bins.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at] + [packed],
                                             [n for n in batch.schema.names if n != "x"] + ["b"])

    types = ", ".join(f"`{c}` {t}" for c, t in ready.drop("x").dtypes)
    return BinnedTable(stage(ready.mapInArrow(to_bins, f"{types}, b binary"), "bins"), layout)


def _unpack(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, width)


def _blocks(rows: DataFrame, width: int, flag: Column) -> DataFrame:
    """The rows as blocks ``n, y, h, flag, b`` of packed values, at most ``PART_ROWS`` rows in each."""
    most = min(PART_ROWS, BLOCK_ROWS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                part = batch.slice(start, most)
                if sum(len(x[0]) for x in held) + part.num_rows > most:
                    yield packed(held)
                    held = []
                y, h, flags = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                held.append((y.astype(np.uint8), h.astype(np.int64), flags.astype(np.uint8), _unpack(part.column(3).to_pylist(), width)))
        if held:
            yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([len(columns[0])], pa.int64())] + [pa.array([c.tobytes()], pa.binary()) for c in columns], ["n", "y", "h", "flag", "b"])

    return rows.select("y", "h", flag.alias("flag"), "b").mapInArrow(pack, "n long, y binary, h binary, flag binary, b binary")


def _arrays(block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, label, hash and flag of the rows of a block."""
    return (np.frombuffer(block.b, np.uint8).reshape(-1, width), np.frombuffer(block.y, np.uint8).astype(np.float64),
            np.frombuffer(block.h, np.int64), np.frombuffer(block.flag, np.uint8).astype(bool))


#: The parts of merged rows as they travel, and their types.
MERGED = {"bins": np.uint8, "y": np.uint8, "inside": np.int32, "outside": np.int32, "h": np.int64}
#: Bytes of a part that travel as one value.
PIECE = 1 << 23


def _merge(rows: DataFrame, width: int, flag: Column) -> DataFrame:
    """The rows with equal ones as one (``trees.Merged``), made by one task that reads them all, staged in pieces ``name, at, data``."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            y, h, flags = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append((_unpack(batch.column(3).to_pylist(), width), y.astype(np.uint8), h.astype(np.int64), flags.astype(bool)))
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        found = trees.Merged.of(*columns)
        for name, kind in MERGED.items():
            data = memoryview(np.ascontiguousarray(getattr(found, name), kind)).cast("B") if len(getattr(found, name)) else b""
            for at in range(0, len(data), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at], pa.int64()), pa.array([bytes(data[at: at + PIECE])], pa.binary())], ["name", "at", "data"])

    return stage(rows.select("y", "h", flag.alias("flag"), "b").coalesce(1).mapInArrow(merge, "name string, at long, data binary"), "merged")


def _collected(staged: DataFrame, width: int) -> dict[str, np.ndarray]:
    found = sorted(staged.collect(), key=lambda r: r["at"])
    discard(staged.sparkSession, staged)
    out = {name: np.frombuffer(b"".join(r["data"] for r in found if r["name"] == name), kind) for name, kind in MERGED.items()}
    out["bins"] = out["bins"].reshape(-1, width)
    return out


@dataclass(frozen=True)
class Fit:
    """One fit of a search: its table, and its parameters."""

    table: int
    params: BoostParams


def _here(spark: SparkSession, shared: dict[int, Broadcast], layouts: Sequence[Layout], fits: Sequence[Fit]) -> list[tuple]:
    """``(models' trees, AUC of the learning rows, AUC of the others)`` of fits that each are one task, over merged tables."""
    jobs = list(fits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"].tolist():
                rows = trees.Merged(**shared[jobs[i].table].value)
                grown, margin = trees.grow_here(layouts[jobs[i].table], rows, jobs[i].params)
                plain = pickle.dumps([{node: vars(n) for node, n in tree.items()} for tree in grown])
                train, valid = (trees.auc(margin[n > 0], rows.y[n > 0], n[n > 0]) for n in (rows.inside, rows.outside))
                yield pd.DataFrame({"id": [i], "trees": [plain], "train": [train], "valid": [valid]})

    made = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, "id long, trees binary, train double, valid double")
    return [([{i: Node(**n) for i, n in tree.items()} for tree in pickle.loads(r["trees"])], r["train"], r["valid"])
            for r in sorted(made.collect(), key=lambda r: r["id"])]


def _validate_here(tables: Sequence[BinnedTable], fits: Sequence[BoostParams]) -> Iterator[tuple[int, int, float | None, float | None]]:
    """``validate`` by fits that each are one task, over as many tables at once as ``BLOCK_BYTES`` hold."""
    spark, layouts, size, shared = tables[0].rows.sparkSession, [t.layout for t in tables], 0, {}
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        staged = list(pool.map(lambda k: _merge(tables[k].rows, layouts[k].width, F.col("fold") != k), range(len(tables))))
    for k in range(len(tables)):
        merged = _collected(staged[k], layouts[k].width)
        size += sum(c.nbytes for c in merged.values())
        shared[k] = spark.sparkContext.broadcast(merged)
        del merged
        if size <= BLOCK_BYTES and k + 1 < len(tables):
            continue
        jobs = [(i, n) for i in range(len(fits)) for n in shared]
        jobs.sort(key=lambda j: -fits[j[0]].n_trees * fits[j[0]].max_depth)  # the long ones first
        made = _here(spark, shared, layouts, [Fit(n, fits[i]) for i, n in jobs])
        yield from ((i, n, valid, train) for (i, n), (_, train, valid) in zip(jobs, made, strict=True))
        for done in shared.values():
            done.destroy()
        size, shared = 0, {}


NOTHING = dict.fromkeys(("gain", "split", "wl", "wr", "hl", "hr", "value", "h"))


class Tasks:
    """What the tasks of a fit in jobs do with a block ``bins, label, hash, margins (fit, row)``."""

    def __init__(self, layout: Layout, fits: list[BoostParams]):
        self.layout, self.fits = layout, fits

    def begin(self, _: None, block) -> tuple:
        bins, y, h, _ = _arrays(block, self.layout.width)
        return bins, y, h, np.stack([np.full(len(y), float(p.base_margin)) for p in self.fits])

    def advance(self, done: list, block: tuple) -> tuple:
        """The block with the values of finished trees added to its margins."""
        bins, y, h, margin = block
        margin = margin.copy()
        for i, state in done:
            tree = Tree.of(self.layout, self.fits[i], state)
            margin[i] += tree.value[tree.walk(bins)] * self.fits[i].learning_rate
        return bins, y, h, margin

    def partial(self, what: tuple, blocks: Iterator[tuple]) -> Iterator[tuple]:
        """``((fit, node), sums)`` over the blocks of a task, for every open node."""
        t, now = what
        total: dict[tuple[int, int], np.ndarray] = {}
        growing = {i: Tree.of(self.layout, self.fits[i], state) for i, state in now.items()}
        for bins, y, h, margin in blocks:
            places = bins + self.layout.offset
            for i, tree in growing.items():
                p = tree.params
                used = trees.drawn_rows(h, p.seed + t, p.row_share)
                got = trees.sums(tree, places, tree.walk(bins), used, *trees.gradients(margin[i], y, p.pos_weight))
                for s, node in enumerate(tree.open.tolist()):
                    total[i, node] = total[i, node] + got[:, s] if (i, node) in total else got[:, s].copy()
        return iter(total.items())

    def best(self, now: dict, items: Iterator[tuple]) -> Iterator[tuple]:
        """``(fit, node, split)``: the best split of every node, from its sums."""
        growing: dict[int, Tree] = {}
        for (i, node), both in items:
            tree = growing.setdefault(i, Tree.of(self.layout, self.fits[i], now[i]))
            yield i, node, {k: v[0] for k, v in trees.choose(tree, np.array([node]), both[:, None]).items()}


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a + b


def _with(kernel, name: str, what):
    """A function of rows that has the tasks' arithmetic do ``name``."""
    def run(rows):
        import pickle as p

        made, layout, fits = p.loads(kernel.value)
        return getattr(made(layout, fits), name)(what, rows)

    return run


def _best_splits(state: RDD, kernel, tasks: Tasks, t: int, now: dict, parts: int, keys: int) -> Iterator[tuple]:
    """``(fit, node, split)`` of every open node. The sums of all tasks are added on the driver if they take ``DRIVER_BYTES`` at most, which
    saves an exchange a level, else where Spark brings them together."""
    partial = state.mapPartitions(_with(kernel, "partial", (t, now)))
    if parts * keys * tasks.layout.total * 16 > DRIVER_BYTES:
        return iter(partial.reduceByKey(_add, min(parts, keys)).mapPartitions(_with(kernel, "best", now)).collect())
    total: dict[tuple[int, int], np.ndarray] = {}
    for key, sums in partial.collect():
        total[key] = total[key] + sums if key in total else sums
    return tasks.best(now, iter(total.items()))


def _in_jobs(spark: SparkSession, table: BinnedTable, rows: DataFrame, count: int, fits: Sequence[BoostParams]) -> list[list[dict[int, Node]]]:
    """The trees of several fits on the same rows, a job for each level of all of them."""
    layout = table.layout
    parts = max(1, -(-count // min(PART_ROWS, BLOCK_ROWS)))
    packed = stage(_blocks(rows.repartition(parts, "h"), layout.width, F.lit(True)), "blocks")

    # the arithmetic goes to the tasks once, not with every job
    kernel = spark.sparkContext.broadcast(cloudpickle.dumps((Tasks, layout, list(fits))))
    tasks = Tasks(layout, list(fits))

    state: RDD = packed.rdd.map(_with(kernel, "begin", None)).persist()
    draws = [Draws(layout, p) for p in fits]
    out: list[list[dict[int, Node]]] = [[] for _ in fits]
    before, written, last = None, None, []
    for t in range(max(p.n_trees for p in fits)):
        if t:
            before, state = state, state.map(_with(kernel, "advance", last)).persist()
            if t % WRITE_EVERY == 0:
                path = folder(spark, "margins")
                state.saveAsPickleFile(path)
                state.unpersist()
                state = spark.sparkContext.pickleFile(path, parts).persist()
                written, old = path, written
                discard(spark, old)
        growing = {i: Tree(layout, p, draws[i].next()) for i, p in enumerate(fits) if t < p.n_trees}
        while now := {i: tree.state() for i, tree in growing.items() if len(tree.open)}:
            keys = sum(len(one["open"]) for one in now.values())
            found: dict[int, list] = {i: [] for i in now}
            for i, node, split in _best_splits(state, kernel, tasks, t, now, parts, keys):
                found[i].append((node, split))
            for i, own in found.items():
                own.sort(key=lambda x: x[0])
                growing[i].absorb(np.array([node for node, _ in own], np.int64), {k: np.array([x[k] for _, x in own]) for k in (own[0][1] if own else NOTHING)})
            if before is not None:
                before.unpersist()
                before = None
        last = [(i, tree.state()) for i, tree in growing.items()]
        for i, tree in growing.items():
            out[i].append(tree.nodes())
    state.unpersist()
    if written:
        discard(spark, written)
    discard(spark, packed)
    return out


def _fits_one_block(rows: int, width: int) -> bool:
    return rows <= BLOCK_ROWS and rows * (width + 18) <= BLOCK_BYTES


def fit_many(table: BinnedTable, fits: Sequence[BoostParams], inside: Column | None = None) -> list[BoostedModel]:
    """M3 for several sets of parameters on the rows where ``inside`` holds."""
    spark = table.rows.sparkSession
    rows = table.rows if inside is None else table.rows.filter(inside)
    count = rows.count()
    if _fits_one_block(count, table.layout.width):
        if not count:
            return [BoostedModel(table.features, [], p.base_margin) for p in fits]
        shared = {0: spark.sparkContext.broadcast(_collected(_merge(rows, table.layout.width, F.lit(True)), table.layout.width))}
        grown = [g for g, _, _ in _here(spark, shared, [table.layout], [Fit(0, p) for p in fits])]
        shared[0].destroy()
    else:
        grown = _in_jobs(spark, table, rows, count, fits)
    return [BoostedModel(table.features, g, p.base_margin) for g, p in zip(grown, fits, strict=True)]


def fit(table: BinnedTable, params: BoostParams) -> BoostedModel:
    """M3: grow ``n_trees`` trees."""
    return fit_many(table, [params])[0]


def validate(tables: Sequence[BinnedTable], fits: Sequence[BoostParams]) -> list[tuple[int, int, float | None, float | None]]:
    """M5: every fit on every table without the rows of the table's own fold: ``(fit, fold, AUC of the fold, AUC of the other rows)``."""
    counts = [t.rows.count() for t in tables]
    if all(_fits_one_block(n, t.layout.width) for n, t in zip(counts, tables, strict=True)):
        return sorted(_validate_here(tables, fits), key=lambda r: r[:2])
    out = []
    for k, table in enumerate(tables):
        models = fit_many(table, fits, F.col("fold") != k)
        scored = score_all(models, table)
        tall = scored.select((F.col("fold") == k).alias("held"), "y", F.posexplode("margins").alias("fit", "margin"))
        for r in metrics.roc_auc_by(tall, "y", "margin", ["fit", "held"]).collect():
            out.append((r["fit"], k, r["held"], r["roc_auc"]))
    found = {(i, k, held): value for i, k, held, value in out}
    return [(i, k, found.get((i, k, True)), found.get((i, k, False))) for i in range(len(fits)) for k in range(len(tables))]


def leaf_values(tree: dict[int, Node], at: np.ndarray) -> np.ndarray:
    size = max(tree) + 1
    values = np.zeros(size)
    for i, node in tree.items():
        values[i] = node.value
    return values[at]


def walk_values(tree: dict[int, Node], x: np.ndarray) -> np.ndarray:
    """The leaf value of every row."""
    at = np.ones(len(x), dtype=np.int64)
    for i in sorted(tree):
        node = tree[i]
        if node.feature >= 0:
            here = at == i
            at[here] = np.where(x[here, node.feature] < node.cut, 2 * i, 2 * i + 1)
    return leaf_values(tree, at)


#: Cells of a tree of which values are kept.
MOST_CELLS = 1 << 13


class Cells:
    """The cells into which the cuts of a tree divide the rows, so that what a tree does with a row is looked up.

    A row's cell is the sum of one number a feature; the codes of rows (how many cuts of the model a value is not below) are found once for
    all trees. Trees of more than ``MOST_CELLS`` cells have none (``count`` 0): their rows are dealt with one by one.
    """

    def __init__(self, tree: dict[int, Node], cuts: dict[int, np.ndarray]):
        own: dict[int, set[float]] = {}
        for node in tree.values():
            if node.feature >= 0:
                own.setdefault(node.feature, set()).add(node.cut)
        self.features = sorted(own)
        steps = [np.array(sorted(own[f])) for f in self.features]
        self.count = int(math.prod(len(s) + 1 for s in steps))
        if self.count > MOST_CELLS:
            self.count = 0
            return
        self.numbers, size = [], 1
        ways = np.arange(self.count)
        self.rows = np.zeros((self.count, 1 + max(self.features, default=0)))  # a row of each cell
        for f, step in zip(self.features, steps, strict=True):
            self.numbers.append(np.append(0, np.searchsorted(step, cuts[f], side="right")) * size)
            self.rows[:, f] = np.append(np.nextafter(step[:1], -np.inf), step)[ways // size % (len(step) + 1)]
            size *= len(step) + 1

    def of(self, codes: dict[int, np.ndarray], rows: int) -> np.ndarray:
        out = np.zeros(rows, np.int64)
        for f, numbers in zip(self.features, self.numbers, strict=True):
            out += numbers.take(codes[f], mode="clip")
        return out


def cuts_of(model: BoostedModel) -> dict[int, np.ndarray]:
    """All cuts of each feature that the model splits by."""
    found: dict[int, set[float]] = {}
    for tree in model.trees:
        for node in tree.values():
            if node.feature >= 0:
                found.setdefault(node.feature, set()).add(node.cut)
    return {f: np.array(sorted(c)) for f, c in found.items()}


def codes_of(cuts: dict[int, np.ndarray], x: np.ndarray) -> dict[int, np.ndarray]:
    """How many cuts each value is not below; a value that is no number is below none, as in a split."""
    return {f: np.searchsorted(c, x[:, f], side="right") for f, c in cuts.items()}


class Scorer:
    """Margins of blocks of raw feature rows."""

    def __init__(self, model: BoostedModel):
        self.model, self.cuts = model, cuts_of(model)
        self.made: list[tuple[Cells, np.ndarray]] | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.model.base_margin)
        if len(x) < MOST_CELLS // 8 and self.made is None:  # less than the tables take
            for tree in self.model.trees:
                out += walk_values(tree, x)
            return out
        if self.made is None:
            self.made = [(c, walk_values(tree, c.rows) if c.count else np.zeros(0)) for tree in self.model.trees for c in [Cells(tree, self.cuts)]]
        codes = codes_of(self.cuts, x)
        for tree, (cells, values) in zip(self.model.trees, self.made, strict=True):
            out += values.take(cells.of(codes, len(x)), mode="clip") if cells.count else walk_values(tree, x)
        return out


def margins(model: BoostedModel, x: np.ndarray) -> np.ndarray:
    """Margins of a block of raw feature rows."""
    return Scorer(model)(x)


def score(model: BoostedModel, df: DataFrame, name: str = "probability") -> DataFrame:
    """M8: add the positive-class probability, in Arrow batches whatever the size of the model."""
    used = sorted(cuts_of(model))
    names = {f: i for i, f in enumerate(used)}
    few = BoostedModel([model.features[f] for f in used], [{i: Node(n.value, n.cover, names.get(n.feature, -1), n.bin, n.cut, n.gain) for i, n in tree.items()}
                                                           for tree in model.trees], model.base_margin)

    @F.pandas_udf(DoubleType())
    def walked(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        scorer = Scorer(few)
        for columns in batches:
            yield pd.Series(scorer(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    # a model without splits still needs a column to be as long as
    return df.withColumn(name, 1 / (1 + F.exp(-walked(*[F.col(f).cast("double") for f in few.features or model.features[:1]]))))


def _binned_tree(layout: Layout, nodes: dict[int, Node]) -> Tree:
    """A finished tree in the form that walks over bins; values as they are."""
    depth = max(nodes).bit_length() - 1
    tree = Tree(layout, BoostParams(max_depth=max(1, depth)), np.zeros(0, np.int64))
    for i, node in nodes.items():
        tree.feature[i], tree.bin[i], tree.value[i] = node.feature, node.bin, node.value
    tree.depth = depth
    return tree


def score_all(models: Sequence[BoostedModel], table: BinnedTable, name: str = "margins") -> DataFrame:
    """The staged rows with the margin of every model, as an array."""
    layout = table.layout
    shared = table.rows.sparkSession.sparkContext.broadcast([(m.base_margin, m.trees) for m in models])  # nodes of the models, whatever the rows

    @F.pandas_udf("array<double>")
    def walked(b: pd.Series) -> pd.Series:
        bins = _unpack(b, layout.width)
        out = np.zeros((len(bins), len(shared.value)))
        for i, (base, grown) in enumerate(shared.value):
            out[:, i] = base
            for nodes in grown:
                tree = _binned_tree(layout, nodes)
                out[:, i] += tree.value[tree.walk(bins)]
        return pd.Series(list(out))

    return table.rows.withColumn(name, walked("b"))


def score_binned(model: BoostedModel, table: BinnedTable, name: str = "probability") -> DataFrame:
    """M8 on a staged binned table."""
    scored = score_all([model], table, "_margins")
    return scored.withColumn(name, 1 / (1 + F.exp(-F.element_at("_margins", 1)))).drop("_margins")


def importance(model: BoostedModel, spark: SparkSession, top: int | None = None) -> DataFrame:
    """M9: mean gain per feature, normalised to one; unused features count zero."""
    splits = model.table(spark).filter(F.col("feature").isNotNull()).groupBy("feature").agg(F.avg("gain").alias("g"))
    names = spark.createDataFrame([(f, i) for i, f in enumerate(model.features)], "feature string, position int")
    table = names.join(splits, "feature", "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    total = table.agg(F.sum("g").alias("total")).first()["total"]
    ranked = table.select("feature", (F.col("g") / F.lit(float(total or math.inf))).alias("importance"), "position")
    ranked = ranked.orderBy(F.desc("importance"), "position").drop("position")
    return ranked.limit(top) if top else ranked
