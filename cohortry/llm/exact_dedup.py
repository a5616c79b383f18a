"""Exact duplicates of whole texts, combined in three steps, with full content compared in each.

Only DataFrame functions. Rows with equal texts are first merged where they are read, then by digest and place (a hash of the
row's id, so that a group of any size is dealt out), then by digest over all places. Texts are grouping keys in all three steps, so
a digest that two texts share cannot join them. Members find their group by digest and place; if texts of one digest differ, by
text as well.

Null text counts as empty; empty texts are equal to each other. Of equal texts the row with the largest id stays. Rows that repeat
an id are rows of their own, each counted. A null id is less than any other and stays if there is no other. An empty table gives no rows. Columns other than the id and the text play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.tables import fresh, slots_of, spread, stage


def groups_of_copies(rows: DataFrame) -> DataFrame:
    """Of rows ``(id, digest, slot, text)``: each text's digest, places, largest id, count, and text if its digest is not its own."""
    by_place = rows.groupBy("digest", "slot", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # dealt by digest alone: texts with one digest meet, and the counts below need no further exchange
    whole = (by_place.repartition("digest").groupBy("digest", "text")
             .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
                  F.expr("bit_or(shiftleft(1L, slot))").alias("slots"), F.max(F.lit(1)).alias("one")))
    single = (whole.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
                                          F.bit_or("slots").alias("slots"), F.sum("one").alias("texts")))
    return whole, single


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256)) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest, text is left out. ``digest`` may be any function."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    rows = rows.withColumn("slot", slots_of(F.col("id")))
    whole, single = groups_of_copies(rows)
    groups = stage(single, "copies")
    members = (rows.drop("text").join(spread(groups.where("texts = 1").drop("texts"), "slots", "slot"), ["digest", "slot"])
               .select("id", "keep_id", "group_size", "digest"))
    shared = groups.where("texts > 1").select("digest")
    if not shared.isEmpty():
        apart = spread(whole.drop("one").join(shared, "digest", "left_semi"), "slots", "slot")
        members = members.unionByName(rows.join(apart, ["digest", "slot", "text"]).select("id", "keep_id", "group_size", "digest"))
    return members.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the largest id, a null id being the least.

    Rows of equal text and id are told apart by their other columns that can be ordered; of rows equal in all, one stays.
    """
    text, there, kept, slot = (fresh(docs, name) for name in ("own_text", "own_null", "own_row", "own_slot"))
    others = [c for c in docs.columns if c != text_col]
    ordered = [c for c in others if c != id_col and "map<" not in docs.schema[c].dataType.simpleString() and "variant" not in docs.schema[c].dataType.simpleString()]
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text), slots_of(F.col(id_col)).alias(slot),
                       F.struct(*[F.col(_quoted(c)).alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).isNotNull().alias("there")).alias(kept),
                       F.struct(*[F.col(_quoted(c)).alias(f"c{i}") for i, c in enumerate([id_col, *ordered])], F.col(text_col).isNotNull().alias("there")).alias(there))
    # the best row of each text where it is read, then of each place, then of all
    best = rows.groupBy(text, slot).agg(F.max_by(kept, there).alias(kept), F.max(there).alias(there)).groupBy(text).agg(F.max_by(kept, there).alias(kept))
    place = {c: i for i, c in enumerate(others)}
    return best.select(*[F.when(F.col(f"{kept}.there"), F.col(text)).cast(docs.schema[c].dataType).alias(c) if c == text_col
                         else F.col(f"{kept}.c{place[c]}").alias(c) for c in docs.columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
