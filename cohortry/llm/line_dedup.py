"""Near-duplicate lines across all documents by an exact set-similarity join, later matches removed.

A line's tokens are its distinct windows of ``shingle`` lower-cased (A-Z) words; with fewer words, the whole line as one. Tokens are
ordered by rarity. Two lines match when the Jaccard similarity of their tokens is at least ``num / den``; candidates share a token of
their prefixes and pass the bounds from lengths and positions, and each is verified on the whole sets. Lines stand in the order of
document id and number. A line is removed if any earlier line matches it, whether or not that one is removed itself; so the result
does not depend on how the work is dealt.

Candidates are first looked for at the head of each list and right before each entry; a line that thereby has an earlier match needs no
other. Only lists entries of lines still without one are joined further, so a crowd of like lines costs a few pairs each.

Lines without words (blank ones too) have no tokens and always stay. Null text stays null, empty text empty. A text that loses all its
lines becomes empty. Rows that repeat an id are one document read more than once: a line of theirs is removed from each or none. A
null id comes first. An empty table gives no rows. All columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm import similar
from cohortry.llm.tables import fresh, stage


def matched(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Nodes that are the later one of a pair of similar nodes, by where each first stands."""
    x, y = (first.select(F.col("node").alias(n), F.col("first").alias(f"{n}_first")) for n in ("x", "y"))
    later = F.when(F.col("x_first") < F.col("y_first"), F.col("y")).otherwise(F.col("x"))
    return pairs.where("similar").join(x, "x").join(y, "y").select(later.alias("node")).distinct()


def removals(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, item)`` of every line to remove."""
    job = similar.Job(docs, similar.lines, shingle, num, den, id_col, text_col)
    worded, _ = job.survey(blank=False)
    first = stage(worded.groupBy("node").agg(F.min(F.struct("id", "item")).alias("first"), *[F.min(c).alias(c) for c in job.signed]), "first")
    lists = job.lists()
    # sets of lines are short: those of all that stand in lists are read once for both rounds
    listed = stage(lists.select("node").distinct().join(first, "node"), "listed")
    sets = job.sets(listed.select("first.id", "first.item"), ("id", "item"))
    verified = job.verify(job.near_pairs(lists), sets)
    late = stage(matched(verified, first), "late")
    # what is still open: entries without an earlier match so far, against all earlier entries of their lists
    waiting = lists.join(late, "node", "left_anti").select("token").distinct()
    state = listed.join(late.withColumn("late", F.lit(True)), "node", "left").select("node", "first", *job.signed, F.coalesce("late", F.lit(False)).alias("late"))

    def is_open(a: str, b: str):
        return F.when(F.col(f"{a}first") < F.col(f"{b}first"), ~F.col(f"{b}late")).otherwise(~F.col(f"{a}late"))

    other = job.other_pairs(lists.join(waiting, "token", "left_semi"), stage(state, "state"), is_open)
    rest = stage(other.join(verified, ["x", "y"], "left_anti"), "open")
    if not rest.isEmpty():
        late = stage(late.unionByName(matched(job.verify(rest, sets), first)), "late").distinct()
    known = first.join(late.withColumn("late", F.lit(True)), "node", "left")
    # a line stays if its node stands here first and has no earlier match
    stays = known.where("late is null").select(F.col("first.id").alias("id"), F.col("first.item").alias("item"))
    stays = stays.select(F.col("id").alias("s_id"), F.col("item").alias("s_item"))
    return worded.select("id", "item").join(stays, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("item") == F.col("s_item")), "left_anti")


def drop_lines(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
               count_col: str | None = None) -> DataFrame:
    """``docs`` with the later matches taken out of its text; ``count_col`` names a column for their number, if wanted."""
    gone = removals(docs, shingle, num, den, id_col, text_col)
    key, mask, count = fresh(docs, "gone_id"), fresh(docs, "gone_mask"), fresh(docs, "gone_count")
    # a text's lines as a string with 1 for those to take out, as far as the last of them
    ones = F.aggregate(F.array_sort("items"), F.lit(""), lambda m, i: F.concat(F.rpad(m, i.cast("int"), "0"), F.lit("1")))
    by_doc = (gone.groupBy("id").agg(F.collect_set("item").alias("items"))
              .select(F.col("id").alias(key), ones.alias(mask), F.size("items").cast("long").alias(count)))
    joined = docs.join(by_doc, F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left")
    lines = F.zip_with(F.split(F.col(text_col), "\n", -1), F.split(F.col(mask), ""), lambda line, out: F.when(F.coalesce(out, F.lit("0")) != "1", line))
    out = joined.withColumn(text_col, F.when(F.col(mask).isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n")))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.col(count), F.lit(0)).cast("long"))
    return out.drop(key, mask, count)
