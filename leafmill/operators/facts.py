"""Facts and quotations: checked against their source, deduplicated, indexed and written out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse


#: Whole words of a quote by which blocks that may hold it are found.
RUN = 3


def check(facts: DataFrame, blocks: DataFrame) -> DataFrame:
    """``facts`` (fact_id, book, block_id, quote, footing) with quote_verified, footing, demoted_from, quote.

    A quote holds when its own block has it as it is, or any block of its book in whatever case. A stated fact without
    support becomes context; the quote of an unsupported one is blanked. Blocks: block_id, book, text.
    """
    wanted = facts.where(F.col("quote") != "").select("fact_id", "book", "block_id", collapse(F.col("quote")).alias("q"))
    near = wanted.join(blocks.select("block_id", F.col("text").alias("t")), "block_id").where(F.contains(collapse(F.col("t")), F.col("q"))).select("fact_id")
    # A quote may begin and end inside words, but those between stand in the text whole: RUN of them find the blocks to
    # look into. Only quotes too short for that meet all blocks of their book.
    low = lambda c: F.lower(collapse(F.col(c)))
    split = wanted.withColumn("w", F.split(F.lower("q"), " ")).withColumn("long", F.size("w") >= RUN + 2)
    keyed = split.where("long").select("fact_id", "book", "q", F.xxhash64(F.slice("w", 2, RUN)).alias("key"))
    words = blocks.select("block_id", "book", F.split(low("text"), " ").alias("w"))
    runs = F.transform(F.when(F.size("w") >= RUN, F.sequence(F.lit(1), F.size("w") - RUN + 1)), lambda i: F.xxhash64(F.slice("w", i, RUN)))
    found = words.select("block_id", "book", F.explode(F.array_distinct(runs)).alias("key")).join(keyed, ["book", "key"]).select("fact_id", "book", "block_id", "q")
    found = found.join(blocks.select("book", "block_id", F.col("text").alias("t")), ["book", "block_id"]).where(F.contains(low("t"), F.lower("q"))).select("fact_id")
    short = split.where("not long").join(blocks.select("book", F.col("text").alias("t")), "book").where(F.contains(low("t"), F.lower("q"))).select("fact_id")
    far = found.union(short)
    held = near.union(far).distinct().withColumn("quote_verified", F.lit(True))
    out = facts.join(held, "fact_id", "left").withColumn("quote_verified", F.coalesce("quote_verified", F.lit(False)))
    demoted = (F.col("footing") == "stated") & ~F.col("quote_verified")
    return out.select(
        "fact_id", "book", "block_id", "quote_verified",
        F.when(demoted, "context").otherwise(F.col("footing")).alias("footing"), F.when(demoted, F.col("footing")).alias("demoted_from"),
        F.when(F.col("quote_verified"), F.col("quote")).otherwise("").alias("quote"),
    )


def first_per(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def last_per(rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last row of each key: an aggregate with partial sums, so a hot key needs no window."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*key, "r.*")


def normalize_tag(tag: Column) -> Column:
    return F.lower(F.trim(F.translate(tag, "_", " ")))


def canonical_tags(tags: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``tags`` (tag, ...) with canonical: itself if known, else a known singular or plural, else itself."""
    tag = normalize_tag(F.col("tag"))
    named = tags.withColumn("t", tag).where(F.col("t") != "")
    tries = F.array(F.struct(F.lit(0).alias("r"), F.col("t").alias("v")), F.struct(F.lit(1).alias("r"), F.concat("t", F.lit("s")).alias("v")), F.struct(F.lit(2).alias("r"), F.regexp_replace("t", "s$", "").alias("v")))
    distinct = named.select("t").distinct()
    known = vocabulary.select(F.col("tag").alias("v")).distinct()
    found = distinct.select("t", F.inline(tries)).join(known, "v").groupBy("t").agg(F.min_by("v", "r").alias("canonical"))
    return named.join(found, "t", "left").withColumn("canonical", F.coalesce("canonical", "t")).drop("t")


def tag_index(tags: DataFrame) -> DataFrame:
    """tag, n: ordered by count, then by name."""
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def grown(old: DataFrame, new: DataFrame) -> DataFrame:
    """Tag counts (tag, n) with new ones added."""
    return old.unionByName(new).groupBy("tag").agg(F.sum("n").alias("n"))


def jsonl(facts: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """keys, line: one JSON object a fact; absent values are left out."""
    return facts.select(*keys, F.to_json(F.struct(*columns)).alias("line"))


def markdown(facts: DataFrame) -> DataFrame:
    """category, n, body: a section of Markdown for each category."""
    line = F.concat(F.lit("- "), F.col("title"), F.lit(" ("), F.col("footing"), F.lit(")"))
    return facts.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", line.alias("s")))), lambda x: x["s"]), "\n").alias("body"))


def bank_files(facts: DataFrame) -> DataFrame:
    """name, content of the files of a bank: a section of Markdown for each category, for ``sources.files`` to write."""
    category = F.regexp_replace(F.lower(F.trim("category")), r"[^\p{L}\p{N}]+", "-")
    body = F.concat(F.lit("# "), F.col("category"), F.lit("\n\n"), F.col("body"), F.lit("\n"))
    return markdown(facts).select(F.concat(category, F.lit(".md")).alias("name"), F.encode(body, "UTF-8").alias("content"))
