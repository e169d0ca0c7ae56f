"""From the blocks of pages to whole documents: seams, checks across pages, paragraphs, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, join_text, rest, word_count

NOT_FLOW = ["footnote", "caption", "table"]
NOT_PROSE = ["heading", "caption", "footnote", "table"]
CHUNK_WORDS, OVERLAP_WORDS = 1200, 200
LEAST_BODY, QUORUM, LEAST_DUPLICATE = 5, 0.6, 200


def should_join(kind: Column, text: Column, next_kind: Column, next_text: Column) -> Column:
    """Whether the next block goes on with this one: a paragraph or verse that ends open before a small letter."""
    ends_open = ~F.rtrim(text).rlike(r"[.!?:;\"')\]]$") | F.rtrim(text).rlike("-$")
    return F.coalesce((kind == next_kind) & kind.isin("paragraph", "verse") & ends_open & F.ltrim(next_text).rlike(r"^\p{Ll}"), F.lit(False))


def seams(blocks: DataFrame) -> DataFrame:
    """``blocks`` (doc_id, bi, kind, text) with ``joins``: whether each goes on with the block before it."""
    order = Window.partitionBy("doc_id").orderBy("bi")
    return blocks.withColumn("joins", should_join(F.lag("kind").over(order), F.lag("text").over(order), F.col("kind"), F.col("text")))


def assemble(blocks: DataFrame) -> DataFrame:
    """doc_id, bi (of the first), kind, n, text of each run of joined blocks; notes and captions stand apart."""
    flow = seams(blocks.where(~F.col("kind").isin("footnote", "caption")))
    island = F.sum((~F.col("joins")).cast("int")).over(Window.partitionBy("doc_id").orderBy("bi"))
    grouped = flow.withColumn("island", island).groupBy("doc_id", "island")
    parts = grouped.agg(F.min("bi").alias("bi"), F.count("*").alias("n"), F.min_by("kind", "bi").alias("kind"), F.array_sort(F.collect_list(F.struct("bi", "text"))).alias("parts"))
    text = F.aggregate(rest(F.col("parts")), F.element_at("parts", 1)["text"], lambda s, p: join_text(s, p["text"]))
    return parts.select("doc_id", "bi", "kind", "n", text.alias("text"))


def flow_ends(blocks: DataFrame) -> DataFrame:
    """doc_id and the first and last blocks that are no note, caption or table."""
    flow = blocks.where(~F.col("kind").isin(NOT_FLOW))
    return flow.groupBy("doc_id").agg(F.min_by("text", "bi").alias("first"), F.min_by("kind", "bi").alias("first_kind"), F.max_by("text", "bi").alias("last"))


def seam_findings(pages: DataFrame, ends: DataFrame) -> DataFrame:
    """book, page_index (of the next page), evidence: a page that ends open before one that starts afresh.

    Pages without body are stepped over; a book's pages are few.
    """
    order = Window.partitionBy("book").orderBy("page_index")
    body = pages.where(~F.col("role").isin("blank", "plate")).join(ends, "doc_id")
    after = lambda c: F.lead(c).over(order)
    pairs = body.select("book", after("page_index").alias("page_index"), collapse(F.col("last")).alias("tail"), collapse(after("first")).alias("head"), after("first_kind").alias("head_kind"))
    open_end = ~F.col("tail").rlike(r"[.!?…:;”’\")\]]$")
    fresh = F.col("head").rlike(r"^[\"“‘'(\p{Lu}]") & (F.col("head_kind") != "heading")
    found = pairs.where((F.col("tail") != "") & (F.col("head") != "") & open_end & fresh)
    return found.select("book", "page_index", F.right("tail", F.lit(40)).alias("before"), F.substring("head", 1, 40).alias("after"))


def duplicate_findings(pages: DataFrame) -> DataFrame:
    """book, page_index, first_page: pages of enough text that a page before them in the book has too."""
    text = collapse(F.col("text"))
    named = pages.where(F.length(text) >= LEAST_DUPLICATE).select("book", "page_index", F.sha2(text, 256).alias("name"))
    first = F.min("page_index").over(Window.partitionBy("book", "name"))
    return named.withColumn("first_page", first).where("page_index > first_page").select("book", "page_index", "first_page")


def furniture_findings(pages: DataFrame) -> DataFrame:
    """book, page_index, missing: pages without the running head or folio that most of the book's body pages have."""
    body = pages.where(~F.col("role").isin("blank", "plate"))
    out = None
    for c in ("running_head", "folio"):
        book = Window.partitionBy("book")
        have, n = F.count(c).over(book), F.count("*").over(book)
        found = body.withColumn("n", n).withColumn("have", have).where((F.col("n") >= LEAST_BODY) & (F.col("have") / F.col("n") >= QUORUM) & F.col(c).isNull())
        found = found.select("book", "page_index", F.lit(c).alias("missing"))
        out = found if out is None else out.union(found)
    return out


def greedy(rows: DataFrame, size: str, limit: int, count: int | None = None, key: str = "doc_id", order: str = "bi") -> DataFrame:
    """``rows`` with ``chunk``: filled in order until the next row would pass ``limit`` (or ``count`` rows).

    A row larger than the limit stays whole; rows of no size never open a chunk. A fold over one document's rows that
    only notes where chunks begin.
    """
    rest = [c for c in rows.columns if c not in (key, order)]
    one = F.struct(F.col(order).alias("o"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(rest)))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("filled"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))

    def step(s, r):
        more = r[f"c{rest.index(size)}"].cast("long")
        new = (s["filled"] > 0) & (s["filled"] + more > limit)
        new = new | (s["n"] + 1 > count) if count is not None else new
        return F.struct(
            F.when(new, more).otherwise(s["filled"] + more).alias("filled"), F.when(new, 1).otherwise(s["n"] + 1).alias("n"), (s["at"] + 1).alias("at"),
            F.when(new, F.array_append(s["begins"], s["at"])).otherwise(s["begins"]).alias("begins"),
        )

    folded = listed.select(key, "rows", F.aggregate("rows", start, step, lambda s: s["begins"]).alias("begins"))
    out = folded.select(key, "begins", F.posexplode("rows").alias("at", "r"))
    chunk = F.size(F.filter("begins", lambda x: x <= F.col("at"))).cast("long").alias("chunk")
    of = {order: F.col("r.o").alias(order)} | {c: F.col(f"r.c{k}").alias(c) for k, c in enumerate(rest)}
    return out.select(*(F.col(key) if c == key else of[c] for c in rows.columns), chunk)


def chunks(blocks: DataFrame, limit: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, bi, words, chunk of each block."""
    return greedy(blocks.select("doc_id", "bi", word_count(F.col("text")).alias("words")), "words", limit)


def prose_chunks(chunked: DataFrame) -> DataFrame:
    """``chunked`` (doc_id, chunk, kind and others) without the chunks that hold no running prose, the others numbered anew."""
    prose = F.max((~F.col("kind").isin(NOT_PROSE)).cast("int"))
    kept = chunked.groupBy("doc_id", "chunk").agg(prose.alias("prose")).where("prose = 1").drop("prose")
    kept = kept.withColumn("_new", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk")) - 1)
    found = chunked.join(kept, ["doc_id", "chunk"])
    return found.select(*(F.col("_new").cast("long").alias("chunk") if c == "chunk" else F.col(c) for c in chunked.columns))


def context(chunked: DataFrame, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """The last blocks of each chunk that the next one is shown: taken from the end while under ``overlap`` words."""
    after = Window.partitionBy("doc_id", "chunk").orderBy(F.desc("bi")).rowsBetween(Window.unboundedPreceding, -1)
    return chunked.withColumn("taken", F.coalesce(F.sum("words").over(after), F.lit(0))).where(F.col("taken") < overlap).drop("taken")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, n (from 0), text: parts between blank lines, white space collapsed."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: collapse(x)), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(parts).alias("n", "text"))


def sample(blocks: DataFrame, count: int = 8, least: int = 40, words: int = 120) -> DataFrame:
    """doc_id, k, text: every floor(n / count)-th longer paragraph, ``count`` at most, its first ``words`` words."""
    long = blocks.where((F.col("kind") == "paragraph") & (word_count(F.col("text")) > least))
    doc = Window.partitionBy("doc_id")
    ranked = long.withColumn("r", F.row_number().over(doc.orderBy("bi")) - 1).withColumn("n", F.count("*").over(doc))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / count))
    taken = ranked.where((F.col("r") % step == 0) & (F.col("r") / step < count))
    head = F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, words)
    return taken.select("doc_id", (F.col("r") / step).cast("long").alias("k"), F.array_join(head, " ").alias("text"))


def anchors(blocks: DataFrame, pictures: DataFrame) -> DataFrame:
    """doc_id, picture, after (bi; null: before all): a picture goes after the last block up to which no block is of a
    later page than its own: an as-of join on the running maximum."""
    order = Window.partitionBy("doc_id").orderBy("bi")
    reached = blocks.select("doc_id", "bi", F.max("page").over(order).alias("page"), F.lit(0).alias("is_picture"), F.lit(None).cast("long").alias("picture"))
    asked = pictures.select("doc_id", F.lit(None).cast("long").alias("bi"), "page", F.lit(1).alias("is_picture"), "picture")
    line = Window.partitionBy("doc_id").orderBy("page", "is_picture", "bi").rowsBetween(Window.unboundedPreceding, 0)
    return reached.union(asked).withColumn("after", F.max("bi").over(line)).where("is_picture = 1").select("doc_id", "picture", "after")


def fit_columns(columns: DataFrame, available: float, least: float) -> DataFrame:
    """``columns`` (table_id, natural) with width: natural if all fit, else a fair share and a part of what others leave."""
    t = Window.partitionBy("table_id")
    total, n = F.sum("natural").over(t), F.count("*").over(t)
    fair = F.lit(float(available)) / n
    base = F.greatest(F.lit(float(least)), F.least(F.col("natural"), fair))
    step = columns.withColumn("total", total).withColumn("base", base).withColumn("want", F.when(F.col("natural") > fair, F.col("natural")).otherwise(0.0))
    spare = F.greatest(F.lit(0.0), available - F.sum("base").over(t))
    wanting = F.sum("want").over(t)
    width = F.when(F.col("total") <= available, F.col("natural")).otherwise(F.col("base") + F.when(wanting > 0, spare * F.col("want") / wanting).otherwise(0.0))
    return step.withColumn("width", width).drop("total", "base", "want")
