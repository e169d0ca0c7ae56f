"""Pages checked against what a scanner read on them, by evidence only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .pages import disposition

DROPPED, ADDED, CONFIDENT, TOLERANCE, LEAST, SHOWN = 0.15, 0.25, 88, 3, 20, 12


def heal_line_breaks(scans: DataFrame, keys: list[str]) -> DataFrame:
    """``scans`` (keys, pos, text, confidence, others) with words joined that a line's end cut in two or more.

    A half ends in a letter and a hyphen (or soft hyphen), and a letter begins what follows it on the page. Halves chain: an
    island of them is one word, with place and other columns of its first and the least confidence.
    """
    order = Window.partitionBy(*keys).orderBy("pos")
    half = F.col("text").rlike("\\p{L}[-\xad]$") & F.coalesce(F.lead("text").over(order).rlike(r"^\p{L}"), F.lit(False))
    marked = scans.withColumn("_half", half)
    marked = marked.withColumn("_new", (~F.coalesce(F.lag("_half").over(order), F.lit(False))).cast("int"))
    marked = marked.withColumn("_word", F.sum("_new").over(order)).withColumn("_part", F.when(F.col("_half"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
    rest = [c for c in scans.columns if c not in (*keys, "pos", "text", "confidence")]
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_part"))), lambda x: x["_part"]), "")
    firsts = [F.min_by(c, "pos").alias(c) for c in rest]
    return marked.groupBy(*keys, "_word").agg(F.min("pos").alias("pos"), parts.alias("text"), F.min("confidence").alias("confidence"), *firsts).drop("_word")


def heal_lists(scans: DataFrame, words: str, page: str) -> DataFrame:
    """``scans`` with the words of a document, an array in their order (``page``, pos, text, confidence, others), healed as
    ``heal_line_breaks`` does it, where they lie. A condition on what comes out makes the arrays anew for each word, unless
    something that Spark can't look through (Python, a checkpoint) lies between."""
    w, half, firsts = F.col(words), F.col("_half"), F.col("_first")

    def halved(x: Column, k: Column) -> Column:
        follows = F.get(w, k + 1)
        return x["text"].rlike("\\p{L}[-\xad]$") & F.coalesce((follows[page] == x[page]) & follows["text"].rlike(r"^\p{L}"), F.lit(False))

    def joined(first: Column, k: Column) -> Column:
        head, end = F.get(w, first), F.coalesce(F.get(firsts, k + 1), F.size(w))
        island = F.sequence(first, end - 1)
        text = lambda i: F.get(w, i)["text"]
        parts = F.transform(island, lambda i: F.when(F.get(half, i), F.left(text(i), F.length(text(i)) - 1)).otherwise(text(i)))
        least = F.array_min(F.transform(island, lambda i: F.get(w, i)["confidence"]))
        return F.when(end - first == 1, head).otherwise(head.withField("text", F.array_join(parts, "")).withField("confidence", least))

    scans = scans.withColumn("_half", F.transform(w, halved))
    places = F.filter(F.sequence(F.lit(0), F.size(w)), lambda k: (k < F.size(w)) & ~F.coalesce(F.get(half, k - 1), F.lit(False)))
    return scans.withColumn("_first", places).withColumn(words, F.transform(firsts, joined)).drop("_half", "_first")


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def _checked(pages: DataFrame, scans: DataFrame, keys: list[str], how: str) -> DataFrame:
    """keys, found: the findings of each page, most severe first."""
    healed = heal_line_breaks(scans.select(*keys, "pos", "text", "confidence"), keys)
    said = F.struct("pos", F.col("confidence").cast("long").alias("confidence"), words(F.col("text")).alias("words"))
    listed = healed.select(*keys, said.alias("w")).groupBy(*keys).agg(F.array_sort(F.collect_list("w")).alias("w"))
    listed = listed.select(*keys, F.transform("w", lambda x: x.dropFields("pos")).alias("_scan"))
    scan = F.coalesce("_scan", F.array().cast("array<struct<confidence:bigint,words:array<string>>>"))
    both = pages.select(*keys, "role", "text", "orphan_notes").join(listed, keys, how)
    both = both.withColumn("_scan", scan).withColumn("_read", words(F.coalesce("text", F.lit(""))))
    both = both.withColumn("n", F.size("_read").cast("long"))
    both = both.withColumn("m", F.aggregate("_scan", F.lit(0), lambda s, x: s + F.size(x["words"])).cast("long"))
    sure = F.filter(F.transform(F.filter("_scan", lambda x: x["confidence"] >= CONFIDENT), lambda x: F.get(x["words"], F.lit(0))), lambda w: F.length(w) > 3)
    skipped = (F.col("role") == "blank") | disposition(F.col("role")).isin("discard", "extract-metadata")
    both = both.withColumn("_missing", F.when(skipped, F.array().cast("array<string>")).otherwise(F.array_except(sure, F.col("_read"))))
    counted = ~F.coalesce(skipped, F.lit(False)) & (F.col("m") >= LEAST)
    n, m, ratio = F.col("n"), F.col("m"), F.col("n") / F.col("m")
    k = F.size("_missing").cast("long")

    def finding(here: Column, code: str, severity: Column, message: Column, shown: Column | None = None) -> Column:
        shown = F.array().cast("array<string>") if shown is None else shown
        rank = F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)
        return F.when(here, F.struct(rank.alias("rank"), F.lit(code).alias("code"), severity.alias("severity"), message.alias("message"), shown.alias("words")))

    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    shorter, longer = _half_up((1 - ratio) * 100), _half_up((ratio - 1) * 100)
    empty = counted & (n == 0)
    high, medium, low = F.lit("high"), F.lit("medium"), F.lit("low")
    # Fixed wording.
    first = finding(empty, "empty-page", high, said("Nothing was transcribed, but OCR read ", m, " words on this page."))
    rest = [
        finding(
            counted & (ratio < 1 - DROPPED), "text-dropped", F.when(shorter > 35, high).otherwise(medium),
            said("The transcription is ", shorter, "% shorter than what OCR read (", n, " words vs ", m, "). Text may have been dropped."),
        ),
        finding(
            counted & (ratio > 1 + ADDED), "text-added", medium,
            said("The transcription is ", longer, "% longer than what OCR read (", n, " words vs ", m, "). Text may have been invented."),
        ),
        finding(
            k > TOLERANCE, "confident-word-missing", F.when(k > 3 * TOLERANCE, high).otherwise(low),
            said(k, " words OCR read clearly are absent from the transcription."), F.slice("_missing", 1, SHOWN),
        ),
        finding(F.col("orphan_notes") > 0, "orphan-footnote", low, said(F.col("orphan_notes"), " footnote(s) have no reference marker to link back to.")),
    ]
    found = F.when(empty, F.array(first)).otherwise(F.filter(F.array(*rest), lambda x: x.isNotNull()))
    # The sort is stable by severity: among equals the order above holds.
    at = lambda x, i: F.struct(x["rank"].alias("rank"), i.alias("i"), x.alias("x"))
    ordered = F.transform(F.array_sort(F.transform(found, at)), lambda x: x["x"])
    return both.select(*keys, ordered.alias("found"))


def page_findings(pages: DataFrame, scans: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """keys, place (most severe first), code, severity, message, words of each finding.

    ``pages``: keys, role, text (null: empty), orphan_notes (footnotes without a mark); ``scans``: keys, pos, text, confidence.
    A page without scanned words is checked against none, or with ``how`` = "inner" left out.
    """
    found = _checked(pages, scans, keys, how).select(*keys, F.posexplode("found").alias("place", "f"))
    return found.select(*keys, "place", "f.code", "f.severity", "f.message", "f.words")


def verify_run(pages: DataFrame, scans: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """keys, n_findings, worst, codes of every page that was read and (``how`` = "inner") scanned, findings or none."""
    worst, codes = F.get("found", F.lit(0))["severity"], F.array_join(F.transform("found", lambda x: x["code"]), ",")
    return _checked(pages, scans, keys, how).select(*keys, F.size("found").cast("long").alias("n_findings"), F.coalesce(worst, F.lit("none")).alias("worst"), codes.alias("codes"))
