"""Stored JSON read strictly: page reads, runs and edits, with what is malformed set apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pricing import half_up
from ..plans.views import ROLES

# Kinds of blocks and of edits, and the versions of a run that can still be read.
KINDS = ["heading", "paragraph", "verse", "blockquote", "list-item", "table", "caption", "footnote", "ornament"]
EDITS = ["text", "retype", "drop", "split", "merge", "note", "image", "section", "retouch", "anchor"]
OLDEST, NEWEST = 5, 10

PAGE = (
    "role string, blocks array<struct<kind:string,text:string,level:double,continuesNext:string>>, uncertain array<string>, "
    "furniture struct<runningHead:string,folio:string>"
)


def page_reads(replies: DataFrame) -> DataFrame:
    """doc_id, ok, role, blocks, uncertain, running_head, folio of each reply (doc_id, body).

    An unknown role or kind, or a block without text, rejects the page. A level is rounded and held within 1 to 6; only
    a literal true sets a flag; what else is missing is empty.
    """
    p = F.from_json("body", PAGE)
    rows = replies.select("doc_id", p.alias("p"))
    blocks = F.coalesce(F.col("p.blocks"), F.array().cast("array<struct<kind:string,text:string,level:double,continuesNext:string>>"))
    good = F.col("p.role").isin(ROLES) & F.col("p.blocks").isNotNull() & F.forall(blocks, lambda b: F.coalesce(b["kind"].isin(KINDS), F.lit(False)) & b["text"].isNotNull())
    clean = F.transform(
        blocks,
        lambda b: F.struct(
            b["kind"].alias("kind"), b["text"].alias("text"), F.least(F.lit(6), F.greatest(F.lit(1), half_up(b["level"]))).cast("int").alias("level"),
            F.coalesce(b["continuesNext"] == "true", F.lit(False)).alias("continues_next"),
        ),
    )
    ok = F.coalesce(good, F.lit(False))
    return rows.select(
        "doc_id", ok.alias("ok"), F.when(ok, F.col("p.role")).alias("role"), F.when(ok, clean).alias("blocks"), F.coalesce("p.uncertain", F.array().cast("array<string>")).alias("uncertain"),
        F.col("p.furniture.runningHead").alias("running_head"), F.col("p.furniture.folio").alias("folio"),
    )


def page_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")


def checkable_text(blocks: Column, head: Column, folio: Column) -> Column:
    """The text with the running head and folio before it, where they aren't blank."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws("\n\n", filled(head), filled(folio), page_text(blocks))


def runs(records: DataFrame) -> DataFrame:
    """id, ok, name, complete, n_pages of each stored run (id, body): of a readable version, with pages; the rest defaulted."""
    r = F.from_json("body", "version int, name string, complete boolean, pages array<int>")
    rows = records.select("id", r.alias("r"))
    ok = F.coalesce(F.col("r.version").between(OLDEST, NEWEST) & F.col("r.pages").isNotNull(), F.lit(False))
    return rows.select(
        "id", ok.alias("ok"), F.when(ok, F.coalesce("r.name", F.lit("Untitled"))).alias("name"), F.when(ok, F.coalesce("r.complete", F.lit(True))).alias("complete"),
        F.when(ok, F.size("r.pages")).alias("n_pages"),
    )


def edits(records: DataFrame) -> DataFrame:
    """id, kind, target of the well-formed edits (id, body): a known kind, its block, and what its kind asks for."""
    e = F.from_json("body", "kind string, blockId string, text string, at double")
    rows = records.select("id", e.alias("e")).select("id", "e.*")
    kind = F.col("kind")
    asks = F.when(kind.isin("text", "retype", "note"), F.col("text").isNotNull()).when(kind == "split", F.col("at") >= 0).otherwise(F.lit(True))
    return rows.where(kind.isin(EDITS) & F.col("blockId").isNotNull() & asks).select("id", "kind", F.col("blockId").alias("target"))


def corrections(edited: DataFrame, pristine: DataFrame) -> DataFrame:
    """The corrections (block_id, text) that change their block (block_id, pristine); null equals null."""
    return edited.join(pristine, "block_id", "left").where(~F.col("text").eqNullSafe(F.col("pristine"))).select("block_id", "text")


def orphan_notes(notes: DataFrame, bodies: DataFrame) -> DataFrame:
    """doc_id, marker of the notes whose marker, digits not beside digits, or its superscript, isn't in their body."""
    raised = F.translate("marker", "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    digits = F.col("marker").rlike("^[0-9]+$")
    pattern = F.when(digits, F.concat(F.lit(r"(?<![0-9])\Q"), "marker", F.lit(r"\E(?![0-9])|(?<![⁰¹²³⁴-⁹])\Q"), raised, F.lit(r"\E(?![⁰¹²³⁴-⁹])"))).otherwise(F.concat(F.lit(r"\Q"), "marker", F.lit(r"\E")))
    both = notes.where(F.trim("marker") != "").join(bodies, "doc_id", "left")
    return both.where(~F.coalesce(F.regexp_like("body", pattern), F.lit(False))).select("doc_id", "marker")


def choose_creator(creators: DataFrame) -> DataFrame:
    """book, name: the author by role, else one without a role, else the first (book, pos, role, name)."""
    rank = F.when(F.col("role") == "aut", 0).when(F.col("role").isNull(), 1).otherwise(2)
    return creators.groupBy("book").agg(F.min_by("name", F.struct(rank.alias("r"), "pos")).alias("name"))


def order_statistic(rows: DataFrame, key: str, value: str, share: float = 0.9) -> DataFrame:
    """key, tone: the value at place floor(share * n) from 0 of each key's sorted values.

    Values are counted first, which partial aggregates add up, so that a key is as many rows as it has different values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    by = Window.partitionBy(key)
    placed = counts.withColumn("upto", F.sum("c").over(by.orderBy(value))).withColumn("n", F.sum("c").over(by))
    return placed.where(F.col("upto") > F.floor(F.col("n") * share)).groupBy(key).agg(F.min(value).alias("tone"))


# The mark and the newest version of a book file.
FORMAT, VERSION = "book-file", 3
BOOK = "format string, version int, title string, edits array<struct<kind:string>>, images array<struct<name:string,path:string,data:string>>"


def book_file(title: Column, edits: Column, images: Column) -> Column:
    """A book as one JSON envelope; an image by its path where it has one, else its bytes as base64."""
    kept = F.transform(
        images,
        lambda i: F.struct(i["name"].alias("name"), i["path"].alias("path"), F.when(i["path"].isNull(), F.replace(F.base64(i["bytes"]), F.lit("\r\n"), F.lit(""))).alias("data")),
    )
    return F.to_json(F.struct(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), title.alias("title"), edits.alias("edits"), kept.alias("images")))


def read_book_files(files: DataFrame) -> DataFrame:
    """id, refused (why it can't be read, or null), title, n_edits, inline (bytes of images held), by_path of each file (id, body)."""
    b = F.from_json("body", BOOK)
    rows = files.select("id", b.alias("b"))
    refused = (
        F.when(F.col("b.format").isNull(), "not json").when(F.col("b.format") != FORMAT, "another format").when(F.col("b.version").isNull() | (F.col("b.version") > VERSION), "a newer version")
    )
    ok = refused.isNull()
    inline = F.aggregate(F.coalesce("b.images", F.array().cast("array<struct<name:string,path:string,data:string>>")), F.lit(0), lambda s, i: s + F.coalesce(F.length(F.unbase64(i["data"])), F.lit(0)))
    return rows.select(
        "id", refused.alias("refused"), F.when(ok, F.col("b.title")).alias("title"), F.when(ok, F.coalesce(F.size("b.edits"), F.lit(0))).alias("n_edits"),
        F.when(ok, inline).alias("inline"), F.when(ok, F.size(F.filter("b.images", lambda i: i["path"].isNotNull()))).alias("by_path"),
    )


def known_spots(stored: DataFrame) -> DataFrame:
    """Stored verdicts (spot_id, verdict, ...) that are known ones of spots named as today."""
    return stored.where(F.col("verdict").isin("present", "not-there", "unclear") & ~F.col("spot_id").rlike(r"^p\d+d\d+$"))
