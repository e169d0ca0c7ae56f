"""Style profiles, editions, voices and model replies: nested records read with defaults, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .versions import NOTE_KINDS

STYLE = "trimSize string, bodyFontSize double, margins struct<inner:double,outer:double>, dropCaps boolean"
# A style's defaults, and a voice's bounds.
TRIM, BODY_SIZE, MARGIN = "6x9", 11.0, 0.75
LEAST_NOTE, MOST_NOTE, EXEMPLARS = 10, 120, 6


def filled(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def edition(title: Column, author: Column, year: Column) -> Column:
    """Details for the title page: blanks are null, no title is Untitled, a notice where author and year are known."""
    notice = F.concat(F.lit("First published "), filled(year), F.lit(", by "), filled(author))
    return F.struct(F.coalesce(filled(title), F.lit("Untitled")).alias("title"), filled(author).alias("author"), notice.alias("notice"))


def style(body: Column) -> Column:
    """A stored style with every field that is missing or out of kind defaulted."""
    s = F.from_json(body, STYLE)
    return F.struct(
        F.coalesce(filled(s["trimSize"]), F.lit(TRIM)).alias("trim"), F.coalesce(s["bodyFontSize"], F.lit(BODY_SIZE)).alias("size"),
        F.coalesce(s["margins"]["inner"], F.lit(MARGIN)).alias("inner"), F.coalesce(s["margins"]["outer"], F.lit(MARGIN)).alias("outer"), F.coalesce(s["dropCaps"], F.lit(False)).alias("drop_caps"),
    )


def described(s: Column) -> Column:
    return F.concat_ws(" · ", s["trim"], F.concat(s["size"].cast("string"), F.lit(" pt")), F.when(s["drop_caps"], "drop caps"))


def voice(kinds: Column, most_words: Column, exemplars: Column) -> Column:
    """A note-writer's settings: length held within bounds, no kinds means context, the last few exemplars."""
    last = F.slice(exemplars, F.greatest(F.lit(1), F.size(exemplars) - EXEMPLARS + 1), EXEMPLARS)
    return F.struct(
        F.least(F.lit(MOST_NOTE), F.greatest(F.lit(LEAST_NOTE), F.coalesce(most_words, F.lit(60)))).alias("most_words"),
        F.when(F.coalesce(F.size(kinds), F.lit(0)) > 0, kinds).otherwise(F.array(F.lit("context"))).alias("kinds"), F.coalesce(last, F.array().cast("array<string>")).alias("exemplars"),
    )


def running_head(text: Column, width: Column, em: float = 0.5) -> Column:
    """A head short enough for ``width``: whole, its part before a colon or semicolon, without its article, fewer words."""
    fits = lambda c: F.length(c) * em <= width
    part = F.trim(F.regexp_extract(text, "^[^:;]*", 0))
    bare = F.regexp_replace(part, "(?i)^(the|a|an) ", "")
    words = F.split(bare, " ")
    fewer = F.filter(
        F.transform(F.sequence(F.size(words), F.lit(1)), lambda n: F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit("…"))), fits
    )
    letters = F.concat(F.substr(bare, F.lit(1), F.greatest(F.lit(0), F.floor(width / em).cast("int") - 1)), F.lit("…"))
    return F.when(fits(text), text).when(fits(part), part).when(fits(bare), bare).otherwise(F.coalesce(F.get(fewer, 0), letters))


REPLY = "stop_reason string, content array<struct<type:string,text:string>>"


def extract_json(body: Column) -> Column:
    """json, reason, retry of a model's reply: the first text part, unless it refused or has none; bad JSON may be retried."""
    r = F.from_json(body, REPLY)
    text = F.get(F.filter(r["content"], lambda c: c["type"] == "text"), 0)["text"]
    parsed = F.try_parse_json(text)
    reason = F.when(r["stop_reason"] == "refusal", "refused").when(text.isNull(), "no text").when(parsed.isNull(), "bad json")
    return F.struct(F.when(reason.isNull(), text).alias("json"), reason.alias("reason"), F.coalesce(reason == "bad json", F.lit(False)).alias("retry"))


def active_step(steps: DataFrame) -> DataFrame:
    """run, step: the first step (run, pos, step, done, can_enter) that is open and may be entered, else the first open, else the last."""
    place = lambda r, at: F.struct(F.lit(r).alias("r"), at.cast("long").alias("at"))
    rank = F.when(~F.col("done") & F.col("can_enter"), place(0, F.col("pos"))).when(~F.col("done"), place(1, F.col("pos"))).otherwise(place(2, -F.col("pos")))
    return steps.groupBy("run").agg(F.min_by("step", rank).alias("step"))


def known_annotations(raw: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations (id, block_id, anchor, text, kind) of known blocks with an anchor and text, an unknown kind being
    context; and how many were dropped."""
    whole = (filled(F.col("anchor")).isNotNull() & filled(F.col("text")).isNotNull()).alias("whole")
    tagged = raw.select("*", F.coalesce(whole, F.lit(False)).alias("whole")).join(blocks.select("block_id").distinct().withColumn("known", F.lit(True)), "block_id", "left")
    good = F.col("whole") & F.coalesce("known", F.lit(False))
    kept = tagged.where(good).select("id", "block_id", filled(F.col("anchor")).alias("anchor"), filled(F.col("text")).alias("text"), F.when(F.col("kind").isin(*NOTE_KINDS), F.col("kind")).otherwise("context").alias("kind"))
    return kept, tagged.agg(F.count_if(~good).alias("dropped"))


def hang(words: DataFrame, em: float = 0.5) -> DataFrame:
    """doc_id, bi, shift_left, shift_right: how far a line's first and last marks stand out into the margin."""
    ratio = lambda c: F.when(c.isin("“", '"', "‘", "'"), 0.5).when(c.isin(".", ",", "-"), 0.7).when(c.isin(";", ":", "!", "?", "”", "’"), 0.4).otherwise(0.0)
    return words.select("doc_id", "bi", (ratio(F.substring("text", 1, 1)) * em).alias("shift_left"), (ratio(F.right("text", F.lit(1))) * em).alias("shift_right"))


def joined_pages(reads: DataFrame, scans: DataFrame) -> DataFrame:
    """Pages read with the words scanned on them; a page without a scan stays, with none."""
    return reads.join(scans, ["doc_id", "page_index"], "left").select("doc_id", "page_index", F.coalesce("n_scanned", F.lit(0)).alias("n_scanned"))
