"""Near-duplicate documents by an exact Jaccard join on word n-grams, using relations between sets to skip work.

A document's set is its distinct windows of ``shingle`` lower-cased (A-Z) words; with fewer words, the whole sequence as one. Documents
link when ``den * |intersection| >= num * |union|``; components of links are found exactly. The two kinds of skipping:

* *Index lists are skipped in blocks by position*: a list holds only the rarest tokens of each set, is cut into blocks by size, entries
  whose positions are too far apart for similar sets are skipped, and a pair must meet early enough to share as many tokens as similar sets do.
* *A set's answers come from those of a set much like it*: a first round links each set to the head of its lists and its
  predecessor there, a second to a few more in an order of each list's own. Sets that are then in one component share their answers: pairs within it are never looked at, lists
  with a single component are passed over, and pairs across components are first decided from the verified overlap of the
  similar set, up to what the two sets differ in.

Documents without words, with empty or with null text have an empty set and link with nothing, not even each other. Rows that repeat
an id are one vertex of the graph. Null ids take part in links, but never name a component that has others. An empty table gives no
rows. Columns other than id and text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm import similar
from cohortry.llm.tables import fresh, slots_of, spread, stage


def roots_of(job: similar.Job, items: DataFrame) -> DataFrame:
    """``(node, root)`` for all nodes with links: the components of all links between different sets."""
    signs = items.where("size > 0").select("node", "size", "marks", *job.signed).dropDuplicates(["node"])
    lists = job.lists()
    nodes = stage(lists.select("node").distinct().join(signs, "node"), "nodes")
    # whole sets are read and sent about for pairs only that may be similar by bits as many as the sets are large
    verified = job.verify(stage(job.likely(job.near_pairs(lists), nodes), "likely"))
    near = stage(similar.components(verified.where("similar").select("x", "y")), "near")
    sizes, listed = nodes.select("node", "size"), nodes.select("node", *job.signed)
    # a few more pairs per entry join most of what the heads of lists have left apart in a crowd of near copies
    state = _state(listed, near)
    more = stage(job.likely(job.next_pairs(_mixed(lists, state), state, _differ).join(verified, ["x", "y"], "left_anti"), nodes), "next")
    if not more.isEmpty():
        again = job.verify(more)
        near = stage(_joined(near, again.where("similar")), "near")
        verified = verified.unionByName(again)
        state = _state(listed, near)
    crossing = job.other_pairs(_mixed(lists, state), state, _differ)
    open_pairs = stage(job.likely(crossing.join(verified, ["x", "y"], "left_anti"), nodes), "open")
    if open_pairs.isEmpty():
        return near
    derived = stage(job.derive(open_pairs, verified, sizes), "derived")
    rest = derived.where("similar is null").select("x", "y")
    links = derived.where("similar").select("x", "y")
    if not rest.isEmpty():
        links = links.unionByName(job.verify(rest).where("similar").select("x", "y"))
    return _joined(near, links)


def _joined(near: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``near`` after some more links: these join whole components, so only their roots are gone over again."""
    x, y = (near.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root")) for n in ("x", "y"))
    joined = links.select("x", "y").join(x, "x", "left").join(y, "y", "left").select(F.coalesce("x_root", "x").alias("x"), F.coalesce("y_root", "y").alias("y"))
    far = stage(similar.components(joined.where("x != y")), "far").select(F.col("node").alias("root"), F.col("root").alias("top"))
    moved = near.join(far, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(far.select(F.col("root").alias("node"), F.col("top").alias("root")).join(near, "node", "left_anti"))


def _state(listed: DataFrame, near: DataFrame) -> DataFrame:
    return stage(listed.join(near, "node", "left").withColumn("root", F.coalesce("root", "node")), "state")


def _differ(a: str, b: str) -> Column:
    return F.col(f"{a}root") != F.col(f"{b}root")


def _mixed(lists: DataFrame, state: DataFrame) -> DataFrame:
    """The lists in which more than one component stands."""
    mixed = (lists.select("token", "node").join(state.select("node", "root"), "node").groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"))
             .where("low != high").select("token"))
    return lists.join(mixed, "token", "left_semi")


def near_duplicates(docs: DataFrame, shingle: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, node (rows with equal sets have equal nodes)."""
    job = similar.Job(docs, similar.documents, shingle, num, den, id_col, text_col)
    items, _ = job.survey(marked=True)
    roots = roots_of(job, items)
    items = items.select("id", "item", "node", "size")
    full = items.where("size > 0").withColumn("slot", slots_of(F.col("id")))
    # rows with equal sets are combined by place first, so that a crowd of copies stays dealt out
    place = full.groupBy("node", "slot").agg(F.min("id").alias("low"))
    nodes = place.groupBy("node").agg(F.min("low").alias("low"), F.expr("bit_or(shiftleft(1L, slot))").alias("slots"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    names = spread(rooted.join(least, "root").select("node", "slots", "component_id"), "slots", "slot")
    out = full.join(names, ["node", "slot"]).select("id", "size", "component_id", "node")
    empty = items.where("size = 0").select("id", "size", F.col("id").alias("component_id"), "node")
    # rows that repeat an id are one vertex: the least of their components
    return out.unionByName(empty).select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", "node")


def keep_one(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller id; all columns are kept."""
    found = near_duplicates(docs, shingle, num, den, id_col, text_col)
    name = fresh(docs, "gone_id")
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
