"""Exact copies by sorting the contents (operator 7).

Texts are normalised (each run of white space becomes one space) and ordered by content: splitters sampled
from a bounded key (first characters and hash) cut the order into ranges, each range is sorted on disk if
need be, and a running comparison of whole neighbouring texts finds where a group of equal ones begins.
Only DataFrame functions are used.

A text that very many rows share is dealt over several sub-groups first; one small row per sub-group is
compared again, so no task holds a hot group.

Defined results: a null text counts as empty; null ids come last; of rows that repeat an id and a text one
stays; an empty table gives an empty result; other columns are carried along by ``keep_first``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewire.llm.common import SPACE
from tidewire.session import materialize

HEAD = 32  # characters of a text that splitters see
HEAVY_ROWS = 1024
HEAVY_TEXTS = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def heavy_texts(docs: DataFrame, text: str) -> DataFrame:
    """Hashes of texts with so many copies that there are at most HEAVY_TEXTS of them, and their parts."""
    least = max(HEAVY_ROWS, -(-docs.count() // HEAVY_TEXTS))
    return (docs.groupBy(F.xxhash64(normalised(F.col(text))).alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
            .where(F.col("__n") >= least)
            .select("__h", F.ceil(F.col("__n") / HEAVY_ROWS).cast("int").alias("__parts")))


def content_order(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` in content order with ``__normal``, ``__part`` (0: not heavy), ``__first`` (smallest id of the
    group so far) and ``__at`` (place in the group)."""
    rows = docs.withColumn("__normal", normalised(F.col(text))).withColumn("__h", F.xxhash64("__normal"))
    heavy = F.broadcast(heavy_texts(docs, text))  # at most HEAVY_TEXTS rows of 12 bytes
    rows = rows.join(heavy, "__h", "left").withColumn(
        "__part", F.when(F.col("__parts").isNull(), 0)
        .otherwise(1 + F.pmod(F.xxhash64(row_id), F.col("__parts"))).cast("int")).drop("__parts")
    rows = rows.withColumn("__head", F.left("__normal", F.lit(HEAD)))
    rows = rows.repartitionByRange("__head", "__h", "__part")
    same = Window.partitionBy("__head", "__h", "__part", "__normal").orderBy(F.col(row_id).asc_nulls_last())
    so_far = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("*", F.first(row_id).over(so_far).alias("__first"), F.row_number().over(same).alias("__at"))


def duplicate_groups(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    ordered = content_order(docs.select(F.col(row_id).alias("__id"), F.col(text).alias("__text")), "__text", "__id")
    lead_text = F.when((F.col("__part") > 0) & (F.col("__at") == 1), F.col("__normal"))
    rows = materialize(ordered.select(
        "__id", "__first", "__at", "__part", F.sha2("__normal", 256).alias("__sha"), lead_text.alias("__lead")),
        "content-order")
    parts = rows.groupBy("__sha", "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__first").alias("__first"), F.max("__lead").alias("__lead"))
    same = Window.partitionBy("__sha", "__lead")
    parts = parts.select(
        "__sha", "__part", F.sum("__n").over(same).alias("group_size"), F.min("__first").over(same).alias("keep_id"),
        (F.row_number().over(same.orderBy(F.col("__first").asc_nulls_last(), "__part")) == 1).alias("__wins"))
    return rows.join(parts, ["__sha", "__part"]).select(
        F.col("__id").alias(row_id), "keep_id", "group_size",
        (F.col("__wins") & (F.col("__at") == 1)).alias("kept"), F.col("__sha").alias("text_sha256"))


def keep_first(docs: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose normalised text an earlier id has; all columns stay as they are."""
    heads = content_order(docs, text, row_id).where("__at = 1")
    parts = Window.partitionBy("__normal").orderBy(F.col(row_id).asc_nulls_last(), "__part")
    heavy = heads.where("__part > 0").withColumn("__at", F.row_number().over(parts)).where("__at = 1")
    return heads.where("__part = 0").unionByName(heavy).select(*[f"`{c}`" for c in docs.columns])
