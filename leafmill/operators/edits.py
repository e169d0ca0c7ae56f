"""One ordered log of edits over books: blocks replayed, and what is pinned to blocks follows them to their new names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import scratch
from ..plans.views import BLANK

BLOCKS = "array<struct<id:string,kind:string,level:int,text:string,sources:array<int>>>"
RENAMES = "array<struct<seq:bigint,old:string,new:string>>"
STRUCTURAL = ("text", "retype", "drop", "split", "merge")


def _stripped(text: Column, blank: str = BLANK) -> Column:
    return F.regexp_replace(text, f"^{blank}+|{blank}+\\z", "")


def replay(blocks: Column, log: Column, blank: str = BLANK) -> Column:
    """blocks and renames after the edits of ``log`` (array of seq, kind, target, value, at, level, in order).

    text and retype replace (a heading keeps or gets a level, nothing else has one), drop removes, split cuts at a place (not
    where a side would be empty) into id/1 and id/2, merge joins the next block on; an edit of a block that isn't there by
    that name does nothing. A split renames the block to its second half, a merge the absorbed block to the absorbing one.
    Both strip the signs of ``blank`` (a pattern of one sign) off the ends of what they make.
    """
    bare = lambda text: _stripped(text, blank)
    start = F.struct(blocks.cast(BLOCKS).alias("blocks"), F.array().cast(RENAMES).alias("renames"))
    kind = f"struct<blocks:{BLOCKS},renames:{RENAMES}>"

    def block(b: Column, **new: Column) -> Column:
        return F.struct(*(new.get(c, b[c]).alias(c) for c in ("id", "kind", "level", "text", "sources")))

    def step(s: Column, e: Column) -> Column:
        all_ = s["blocks"]
        i = F.array_position(F.transform(all_, lambda b: b["id"]), e["target"]).cast("int")
        b, after = F.get(all_, i - 1), F.get(all_, i)

        def put(n: int, *new: Column) -> Column:
            rest = F.slice(all_, i + n, F.size(all_))
            return F.concat(F.slice(all_, F.lit(1), i - 1), F.array(*new).cast(BLOCKS), rest) if new else F.concat(F.slice(all_, F.lit(1), i - 1), rest)

        at = F.greatest(F.lit(0), F.least(F.length(b["text"]), e["at"].cast("int")))
        left, right = bare(F.substring(b["text"], F.lit(1), at)), bare(F.substring(b["text"], at + 1, F.length(b["text"])))
        cut = (e["kind"] == "split") & (left != "") & (right != "")
        joined = (e["kind"] == "merge") & (i < F.size(all_))
        between = F.when((b["kind"] == "table") | (after["kind"] == "table"), "\n").otherwise(" ")
        level = F.when(e["value"] == "heading", F.coalesce(e["level"], b["level"], F.lit(1)))
        one, two = F.concat(b["id"], F.lit("/1")), F.concat(b["id"], F.lit("/2"))
        changed = (
            F.when(F.coalesce(i, F.lit(0)) == 0, all_)
            .when(e["kind"] == "text", put(1, block(b, text=e["value"])))
            .when(e["kind"] == "retype", put(1, block(b, kind=e["value"], level=level)))
            .when(e["kind"] == "drop", put(1))
            .when(cut, put(1, block(b, id=one, text=left), block(b, id=two, text=right)))
            .when(joined, put(2, block(b, text=bare(F.concat(bare(b["text"]), between, bare(after["text"]))), sources=F.array_sort(F.array_union(b["sources"], after["sources"])))))
            .otherwise(all_)
        )
        here = F.coalesce(i, F.lit(0)) > 0
        name = lambda old, new: F.array(F.struct(e["seq"].cast("long").alias("seq"), old.alias("old"), new.alias("new"))).cast(RENAMES)
        renamed = F.when(here & cut, F.concat(s["renames"], name(b["id"], two))).when(here & joined, F.concat(s["renames"], name(after["id"], b["id"]))).otherwise(s["renames"])
        return F.struct(changed.alias("blocks"), renamed.alias("renames")).cast(kind)

    return F.aggregate(log, start.cast(kind), step)


def replayed(blocks: DataFrame, log: DataFrame, blank: str = BLANK) -> DataFrame:
    """doc_id, book (blocks and renames): each document's blocks (doc_id, bi, id, kind, text, optionally level) after its edits
    (doc_id, seq, kind, target, value, at, optionally level). Kinds that don't change blocks are passed over."""
    level = lambda df: F.col("level") if "level" in df.columns else F.lit(None).cast("int")
    row = F.struct("bi", "id", "kind", level(blocks).cast("int").alias("level"), "text", F.array(F.floor(F.col("bi") / 4).cast("int")).alias("sources"))
    own = blocks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["id"], x["kind"], x["level"], x["text"], x["sources"])).cast(BLOCKS).alias("blocks"))
    edit = F.struct("seq", "kind", "target", "value", F.col("at").cast("int").alias("at"), level(log).cast("int").alias("level"))
    edits = log.where(F.col("kind").isin(*STRUCTURAL)).groupBy("doc_id").agg(F.array_sort(F.collect_list(edit)).alias("log"))
    none = F.array().cast(edits.schema["log"].dataType)
    return own.join(edits, "doc_id", "left").select("doc_id", replay(F.col("blocks"), F.coalesce("log", none), blank).alias("book"))


def kept_blocks(books: DataFrame, blank: str = BLANK) -> DataFrame:
    """doc_id, n, id, kind, level, text, sources of what is left; blocks left empty go."""
    left = F.filter("book.blocks", lambda b: _stripped(b["text"], blank) != "")
    return books.select("doc_id", F.posexplode(left).alias("n", "b")).select("doc_id", "n", "b.*")


def renames(books: DataFrame) -> DataFrame:
    """doc_id, seq, old, new of the blocks that splits and merges renamed."""
    return books.select("doc_id", F.inline("book.renames"))


def apply_edits(blocks: DataFrame, log: DataFrame, blank: str = BLANK) -> DataFrame:
    """doc_id, n, id, kind, level, text, sources after each document's edits."""
    return kept_blocks(replayed(blocks, log, blank), blank)


def _next(rows: DataFrame, block: str, named: DataFrame) -> DataFrame:
    """``rows`` (doc_id, seq, others) with ``then``: when the block they name is renamed next, if it is."""
    rest = [c for c in rows.columns if c not in ("doc_id", "seq", block)]
    asked = rows.select("doc_id", F.col(block).alias("_block"), "seq", F.lit(None).cast("long").alias("_at"), F.struct(F.lit(1).alias("_"), *rest).alias("_row"))
    known = named.select("doc_id", F.col("old").alias("_block"), "seq", F.col("seq").alias("_at"), F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"))
    ahead = Window.partitionBy("doc_id", "_block").orderBy("seq").rangeBetween(1, Window.unboundedFollowing)
    found = asked.unionByName(known).withColumn("then", F.min("_at").over(ahead)).where("_row is not null")
    return found.select("doc_id", F.col("_block").alias(block), "seq", "then", *(F.col(f"_row.{c}").alias(c) for c in rest))


def last_names(named: DataFrame) -> DataFrame:
    """doc_id, seq, new: the name that the block renamed at ``seq`` has at last.

    Each rename points at the one that takes its new name away later; pointers are doubled until none is left, in as many
    rounds as the logarithm of the longest chain.
    """
    now = scratch.keep(_next(named.select("doc_id", "seq", "new"), "new", named))
    while not now.where("then is not null").isEmpty():
        after = now.select("doc_id", F.col("seq").alias("then"), F.col("new").alias("_new"), F.col("then").alias("_then"))
        step = now.join(after, ["doc_id", "then"], "left")
        old, now = now, scratch.keep(step.select("doc_id", F.coalesce("_new", "new").alias("new"), "seq", F.col("_then").alias("then")))
        scratch.drop(old)
    return now.select("doc_id", "seq", "new")


def follow(log: DataFrame, named: DataFrame) -> DataFrame:
    """``log`` whose anchors and images name the block that theirs has become after all edits behind them (``renames``).

    Notes stay: one whose block is gone by that name is left out of the book.
    """
    pinned = F.col("kind").isin("anchor", "image") & F.col("block_id").isNotNull()
    named = scratch.keep(named)
    placed = _next(log.where(pinned).withColumn("seq", F.col("seq").cast("long")), "block_id", named)
    ends = last_names(named).select("doc_id", F.col("seq").alias("then"), F.col("new").alias("_new"))
    moved = placed.join(ends, ["doc_id", "then"], "left").withColumn("block_id", F.coalesce("_new", "block_id"))
    return log.where(~pinned | F.col("block_id").isNull()).unionByName(moved.select(*log.columns))
