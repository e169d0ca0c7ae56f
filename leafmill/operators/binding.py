"""Pages bound into a book: what leaves the flow, what goes on across pages, and what is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_text, rest, strip_soft_hyphens
from .assemble import should_join
from .notes import marker_pattern, strip_marker
from .pages import disposition

# Fixed wording.
LEFT_OUT = "you chose to leave this page out"
MINED = "Used for book details; replaced by your own front matter."
REMADE = "Regenerated for this edition, or blank."


def sorted_pages(pages: DataFrame, excluded: DataFrame) -> DataFrame:
    """book, page_index, role, target (body, aside or null), reason (why a page is left out), gaps (excluded pages before it)."""
    out = excluded.select("book", "page_index", F.lit(True).alias("out")).distinct()
    d = disposition(F.col("role"))
    reason = F.when(F.col("out"), LEFT_OUT).when(d == "extract-metadata", MINED).when(d == "discard", REMADE)
    rows = pages.select("book", "page_index", "role").join(out, ["book", "page_index"], "left").withColumn("reason", reason)
    before = Window.partitionBy("book").orderBy("page_index").rowsBetween(Window.unboundedPreceding, -1)
    gaps = F.coalesce(F.sum(F.coalesce("out", F.lit(False)).cast("int")).over(before), F.lit(0))
    target = F.when(F.col("reason").isNull(), F.when(d == "transcribe-aside", "aside").otherwise("body"))
    return rows.select("book", "page_index", "role", target.alias("target"), "reason", gaps.alias("gaps"))


def skipped(pages: DataFrame) -> DataFrame:
    """book, page_index, role, reason of the pages of ``sorted_pages`` that are left out."""
    return pages.where("reason is not null").select("book", "page_index", "role", "reason")


def _kept(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    return blocks.join(pages.where("target is not null").select("book", "page_index", "target", "gaps"), ["book", "page_index"])


def _captions(pages: DataFrame, blocks: DataFrame, pictures: DataFrame) -> DataFrame:
    """book, page_index, bi, k, caption: captions that a picture of their page takes, the k-th the k-th."""
    page = Window.partitionBy("book", "page_index").orderBy("bi")
    found = _kept(pages, blocks).where("kind = 'caption'").withColumn("k", F.row_number().over(page))
    n = pictures.groupBy("book", "page_index").agg(F.count("*").alias("n"))
    return found.join(n, ["book", "page_index"]).where("k <= n").select("book", "page_index", "bi", "k", strip_soft_hyphens(F.trim("text")).alias("caption"))


def captioned(pages: DataFrame, blocks: DataFrame, pictures: DataFrame) -> DataFrame:
    """book, page_index, picture_id, caption (null: none left) of the pictures (book, page_index, n, picture_id) of kept pages."""
    page = Window.partitionBy("book", "page_index").orderBy("n", "picture_id")
    there = pages.where("target is not null").select("book", "page_index")
    ranked = pictures.join(there, ["book", "page_index"]).withColumn("k", F.row_number().over(page))
    return ranked.join(_captions(pages, blocks, pictures).drop("bi"), ["book", "page_index", "k"], "left").select("book", "page_index", "picture_id", "caption")


def bound(pages: DataFrame, blocks: DataFrame, pictures: DataFrame) -> DataFrame:
    """book, target, place, id, kind, level, text, n, pages: the flow of each book, body and asides apart.

    ``blocks``: book, page_index, bi, kind, text, level, continues_next, continues_previous. A block is joined to the one
    before it in its part if either says so or the text does; never the first behind a page that was chosen to be left
    out, whose end then doesn't go on either. Pages dropped by their role don't part what they lie between. A joined
    block has the id of its first part and the pages of all.
    """
    taken = _captions(pages, blocks, pictures).select("book", "page_index", "bi")
    flow = _kept(pages, blocks).where("kind <> 'footnote'").join(taken, ["book", "page_index", "bi"], "left_anti")
    reading = Window.partitionBy("book").orderBy("page_index", "bi")
    part = Window.partitionBy("book", "target").orderBy("page_index", "bi")
    parted = F.col("gaps") > F.lag("gaps").over(reading)
    apart = (F.col("target") == "body") & (F.col("gaps") > F.lag("gaps").over(part))
    kind, text = F.lag("kind").over(part), F.lag("text").over(part)
    said = (F.lag("continues_next").over(part) & ~F.coalesce(apart, F.lit(False))) | F.col("continues_previous")
    same = (kind == F.col("kind")) & F.col("kind").isin("paragraph", "verse")
    open_ = should_join(kind, text, F.col("kind"), F.col("text")) & (F.trim(text) != "")
    joins = same & (F.coalesce(said, F.lit(False)) | open_) & ~F.coalesce(parted, F.lit(False))
    flow = flow.withColumn("new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("island", F.sum("new").over(part))
    row = F.struct("page_index", "bi", "kind", "level", "text")
    groups = flow.groupBy("book", "target", "island").agg(F.array_sort(F.collect_list(row)).alias("parts"))
    first = F.element_at("parts", 1)
    joined = F.aggregate(rest(F.col("parts")), first["text"], lambda s, p: join_text(s, p["text"]))
    name = F.concat(F.lit("p"), first["page_index"].cast("string"), F.lit("b"), first["bi"].cast("string"))
    return groups.select(
        "book", "target", (F.col("island") - 1).alias("place"), name.alias("id"), first["kind"].alias("kind"), F.when(first["kind"] == "heading", first["level"]).alias("level"),
        strip_soft_hyphens(joined).alias("text"), F.size("parts").alias("n"), F.array_distinct(F.col("parts.page_index")).alias("pages"),
    )


def book_notes(pages: DataFrame, blocks: DataFrame, flow: DataFrame) -> DataFrame:
    """book, note_id, page_index, marker, text, orphaned: the notes of kept pages, numbered through the book; one whose marker
    (by default a star) no block of the body has is an orphan."""
    reading = Window.partitionBy("book").orderBy("page_index", "bi")
    found = _kept(pages, blocks).where("kind = 'footnote'").withColumn("note_id", F.concat(F.lit("fn"), F.row_number().over(reading).cast("string")))
    found = found.withColumn("marker", F.coalesce("marker", F.lit("*"))).withColumn("pattern", marker_pattern(F.col("marker")))
    asked = found.select("book", "pattern").where("pattern is not null").distinct()
    met = asked.join(flow.where("target = 'body'").select("book", "text"), "book").where(F.rlike(F.col("text"), F.col("pattern"))).select("book", "pattern").distinct()
    joined = found.join(met.withColumn("met", F.lit(True)), ["book", "pattern"], "left")
    clean = strip_marker(strip_soft_hyphens(F.trim("text")), F.col("marker"))
    return joined.select("book", "note_id", "page_index", "marker", clean.alias("text"), F.col("met").isNull().alias("orphaned"))


def contents(flow: DataFrame) -> DataFrame:
    """book, id, title, level, place, page: the chapters, by the headings of the body."""
    rows = flow.where("target = 'body' and kind = 'heading'")
    return rows.select("book", "id", F.trim("text").alias("title"), F.coalesce("level", F.lit(1)).alias("level"), "place", F.element_at("pages", 1).alias("page"))
