"""How far a text reads as typed rather than scanned, from the shapes of its words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import JUNK
from ..plans.views import dealt, tokens

LEAST_WORDS, CLEAN, NOISE, MIXED, VOUCHED = 200, 0.985, 0.004, 0.9, 3


def _key(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), r"[^\p{L}\p{N}'’-]", "")


def assess(docs: DataFrame, vouched: int = VOUCHED) -> DataFrame:
    """doc_id, words, score, noise, flips, mixed, verdict of every document (null or empty: no words, mixed).

    Texts are shuffled once, by document; counts of words and of what vouches for them are then made where they lie.
    """
    docs = dealt(docs)
    shape = tokens(docs).groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    bare = F.regexp_replace("token", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    shape = shape.withColumn("bare", bare).withColumn("said", _key(F.col("token"))).withColumn("key", _key(F.col("bare")))
    # A word vouches under its own key and is looked up under its bare one, mostly the same: then one row does both.
    row = lambda key, adds, asks: F.struct(key.alias("key"), adds.alias("adds"), F.lit(asks).alias("asks"))
    adds = F.when(F.length("said") > 1, F.col("n")).otherwise(0)
    both = F.when(F.col("said") == F.col("key"), F.array(row(F.col("key"), adds, True))).otherwise(F.array(row(F.col("said"), adds, False), row(F.col("key"), F.lit(0).cast("long"), True)))
    shape = shape.select("doc_id", "token", "bare", "n", F.inline(both)).withColumn("times", F.sum("adds").over(Window.partitionBy("doc_id", "key")))
    shape = shape.where(F.col("asks") & ~F.col("token").rlike(r"^[^\p{L}\p{N}]+$"))
    bare = F.col("bare")
    marks = shape.select(
        "doc_id", "n",
        F.col("token").rlike(JUNK).alias("junk"),
        bare.rlike(r"\p{Ll}\p{Lu}").alias("flip"),
        (bare.rlike(r"\p{L}") & bare.rlike(r"\p{N}")).alias("alnum"),
        (bare.rlike(r"^\p{L}[\p{L}'’-]*$") | bare.rlike(r"^\p{N}[\p{N}.,:/-]*$") | ((F.length("key") > 1) & (F.coalesce("times", F.lit(0)) >= vouched))).alias("good"),
    )
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    sums = marks.groupBy("doc_id").agg(
        F.sum("n").alias("words"),
        total(F.col("good") & ~F.col("junk") & ~F.col("flip") & ~F.col("alnum")).alias("clean"),
        *(total(F.col(c)).alias(c) for c in ("junk", "flip", "alnum")),
    )
    words = F.coalesce("words", F.lit(0))
    share = lambda c: F.when(words > 0, F.col(c) / words).otherwise(0.0)
    out = docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", words.alias("words"), *(share(c).alias(a) for c, a in (("clean", "score"), ("junk", "noise"), ("flip", "flips"), ("alnum", "mixed"))))
    verdict = (
        F.when(F.col("words") < LEAST_WORDS, "mixed").when((F.col("score") >= CLEAN) & (F.col("noise") <= NOISE), "trustworthy")
        .when(F.col("score") >= MIXED, "mixed").otherwise("garbage")
    )
    return out.withColumn("verdict", verdict)


def signals(assessed: DataFrame) -> DataFrame:
    """``assessed`` with the reasons for its verdict, in a fixed order."""
    enough = F.col("words") >= LEAST_WORDS
    percent = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    tenths = F.floor(F.col("noise") * 1000 + 0.5).cast("long")
    tenths = F.when(tenths % 10 == 0, (tenths / 10).cast("long").cast("string")).otherwise(F.format_string("%.1f", tenths / 10))
    # The wording of the reasons.
    said = F.array(
        F.when(~enough, "too little text to judge"),
        F.when(enough & (F.col("score") < CLEAN), F.concat(percent((1 - F.col("score")) * 100), F.lit("% of words don’t read as words"))),
        F.when(enough & (F.col("noise") > NOISE), F.concat(tenths, F.lit("% carry stray symbols"))),
        F.when(enough & (F.col("flips") > 0.005), "capitals appear inside words"),
        F.when(enough & (F.col("mixed") > 0.005), "digits appear inside words"),
    )
    return assessed.withColumn("signals", F.array_join(F.array_compact(said), ", "))


def describe(signalled: DataFrame) -> DataFrame:
    """``signalled`` with a sentence for its verdict."""
    why = F.when(F.col("signals") != "", F.concat(F.lit(" — "), F.col("signals"))).otherwise("")
    # The wording of the verdicts.
    sentence = (
        F.when(F.col("words") < LEAST_WORDS, "There is too little text here to judge it.")
        .when(F.col("verdict") == "trustworthy", "This text reads as typed rather than scanned — it can be used as it stands.")
        .when(F.col("verdict") == "garbage", F.concat(F.lit("This text reads as poor machine OCR"), why, F.lit(".")))
        .otherwise(F.concat(F.lit("This text reads as machine OCR"), why, F.lit(".")))
    )
    return signalled.withColumn("sentence", sentence)
