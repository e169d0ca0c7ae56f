"""Proposed notes: checked against the blocks they name, turned into edits, and kept as facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.text import collapse, word_count
from .facts import normalize_tag


def check_proposals(proposals: DataFrame, blocks: DataFrame, books: DataFrame) -> DataFrame:
    """``proposals`` (book, block_id, anchor, text) with at (where the anchor ends in its block; null if it isn't there) and
    outside (claims of the note that the book's text doesn't have). Blocks: block_id, text. Books: book, text."""
    named = proposals.join(blocks.select("block_id", F.col("text").alias("_block")), "block_id", "left")
    named = named.withColumn("at", markup.anchor_end(F.coalesce("_block", F.lit("")), F.col("anchor"))).drop("_block")
    known = books.select("book", F.lower(collapse(F.col("text"))).alias("_book"))
    made = named.withColumn("_claims", markup.claims_in(F.col("text"))).join(known, "book", "left")
    outside = F.filter("_claims", lambda c: ~F.contains(F.coalesce("_book", F.lit("")), F.lower(c)))
    return made.withColumn("outside", outside).drop("_claims", "_book")


def note_edits(accepted: DataFrame) -> DataFrame:
    """block_id, at, text, unplaced of accepted proposals (block_id, at, text): without text none, without a place unplaced."""
    body = F.trim(F.col("text"))
    return accepted.where(body != "").select("block_id", "at", body.alias("text"), F.col("at").isNull().alias("unplaced"))


def facts_of_notes(notes: DataFrame, blocks: DataFrame, least_words: int = 12) -> DataFrame:
    """title, body, footing, category, block_id, source_page, quote_verified of notes (block_id, anchor, text, kind) that say
    enough. Blocks: block_id, source_page."""
    long = notes.where(word_count(F.col("text")) >= least_words)
    tag = normalize_tag(F.col("kind"))
    joined = long.join(blocks.select("block_id", "source_page", F.lit(True).alias("_there")), "block_id", "left")
    return joined.select(
        F.col("anchor").alias("title"), F.col("text").alias("body"), F.lit("context").alias("footing"), F.when(tag == "", "general").otherwise(tag).alias("category"),
        "block_id", "source_page", F.coalesce("_there", F.lit(False)).alias("quote_verified"),
    )
