"""What an editor adds to a book: notes, pictures and their places, sections, retouching. The last edit of a thing counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import last_per


def _last(edits: DataFrame, kind: str, *fields: str) -> DataFrame:
    """doc_id, target and fields of the last edit of ``kind`` on each target (edits: doc_id, seq, kind, target, ...)."""
    return last_per(edits.where(F.col("kind") == kind).select("doc_id", "target", "seq", *fields), ["doc_id", "target"], "seq").select("doc_id", "target", *fields)


def notes(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, note_id, block_id, at, text: notes with text on blocks (doc_id, block_id) that are still there."""
    found = _last(edits, "note", "block_id", "at", "value").withColumn("text", F.trim("value")).where("text <> ''")
    return found.join(blocks.select("doc_id", "block_id"), ["doc_id", "block_id"]).select("doc_id", F.col("target").alias("note_id"), "block_id", "at", "text")


def size_after(ops: Column, width: Column, height: Column) -> Column:
    """Width and height after ops (op, x, y, width, height, degrees): crops stay inside, odd quarter turns swap the sides."""
    start = F.struct(width.cast("int").alias("w"), height.cast("int").alias("h"))
    inside = lambda v, low, high: F.least(F.greatest(v, F.lit(low)), high)

    def step(s: Column, o: Column) -> Column:
        x, y = (inside(F.coalesce(o[c], F.lit(0)), 0, s[side] - 1) for c, side in (("x", "w"), ("y", "h")))
        cut = F.struct(inside(F.coalesce(o["width"], s["w"] - x), 1, s["w"] - x).alias("w"), inside(F.coalesce(o["height"], s["h"] - y), 1, s["h"] - y).alias("h"))
        turned = F.struct(s["h"].alias("w"), s["w"].alias("h"))
        return F.when(o["op"] == "crop", cut).when((o["op"] == "rotate") & (F.coalesce(o["degrees"], F.lit(0)) % 180 == 90), turned).otherwise(s)

    return F.aggregate(ops, start, step)


def _retouched(pictures: DataFrame, edits: DataFrame) -> DataFrame:
    ops = _last(edits, "retouch", "ops").select("doc_id", F.col("target").alias("picture_id"), "ops")
    none = F.array().cast(edits.schema["ops"].dataType)
    sized = pictures.join(ops, ["doc_id", "picture_id"], "left").withColumn("s", size_after(F.coalesce("ops", none), F.col("width"), F.col("height")))
    return sized.select("doc_id", "picture_id", "block_id", F.col("s.w").alias("width"), F.col("s.h").alias("height"))


def supplied_pictures(edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, picture_id, block_id (null: in front), width, height of pictures given, behind blocks that are still there."""
    given = _last(edits, "image", "block_id", "width", "height").withColumnRenamed("target", "picture_id")
    there = blocks.select("doc_id", "block_id", F.lit(True).alias("there"))
    return _retouched(given.join(there, ["doc_id", "block_id"], "left").where("block_id is null or there"), edits)


def own_pictures(pictures: DataFrame, edits: DataFrame, blocks: DataFrame) -> DataFrame:
    """A book's ``pictures`` (doc_id, picture_id, block_id, width, height) where their last anchor puts them; an anchor at a
    block that is gone doesn't count."""
    moved = _last(edits, "anchor", "block_id").select("doc_id", F.col("target").alias("picture_id"), F.col("block_id").alias("to"), F.lit(True).alias("moved"))
    there = blocks.select("doc_id", F.col("block_id").alias("to"), F.lit(True).alias("there"))
    placed = pictures.join(moved, ["doc_id", "picture_id"], "left").join(there, ["doc_id", "to"], "left")
    follows = F.col("moved") & (F.col("to").isNull() | F.col("there"))
    return _retouched(placed.withColumn("block_id", F.when(follows, F.col("to")).otherwise(F.col("block_id"))), edits)


def sections(edits: DataFrame) -> DataFrame:
    """doc_id, section_id, title, n, text: the paragraphs of sections, cut at blank lines; none without prose."""
    parts = F.filter(F.transform(F.split("value", r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    title = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "Introduction").otherwise(F.trim("title"))
    return _last(edits, "section", "value", "title").select("doc_id", F.col("target").alias("section_id"), title.alias("title"), F.posexplode(parts).alias("n", "text"))
