"""Notes of a document: which place in the text each belongs to, in reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import superscript
from ..plans import scratch
from ..plans.views import BLANK

_RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹"
_DIGITS = r"^[0-9]+$"


def _bare(marker: Column) -> Column:
    return F.regexp_replace(F.coalesce(marker, F.lit("")), f"^{BLANK}+|{BLANK}+$", "")


def _literal(text: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def marker_pattern(marker: Column) -> Column:
    """What a note's printed marker looks like in the text, null without one; digits, plain or raised, stand apart from
    further ones."""
    bare = _bare(marker)
    digits = F.concat(F.lit("(?<![0-9])"), bare, F.lit(f"(?![0-9])|(?<![{_RAISED}])"), superscript(bare), F.lit(f"(?![{_RAISED}])"))
    return F.when(bare.rlike(_DIGITS), digits).when(bare != "", _literal(bare))


def strip_marker(text: Column, marker: Column) -> Column:
    """A note without the marker that it begins with; a note of nothing else stays."""
    text, bare = _bare(text), _bare(marker)
    behind = F.lit(r"(?:[.)\]:]\s*|\s+)(?=[\s\S])")
    cut = lambda form: F.regexp_replace(text, F.concat(F.lit("^"), _literal(form), behind), F.lit(""))
    raised = F.when(bare.rlike(_DIGITS), cut(superscript(bare))).otherwise(text)
    return F.when(bare == "", text).when(cut(bare) != text, cut(bare)).otherwise(raised)


def _keys(text: Column) -> Column:
    """What a block's text holds that markers are looked up by: its numbers, raised ones as plain, and its signs."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"[0-9]+|[{_RAISED}]+"), 0), lambda x: F.translate(x, _RAISED, "0123456789"))
    return F.array_distinct(F.concat(numbers, F.split(text, "")))


def places(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, note_id, bi, start, stop (code points from 0): where each note could go, one place a block. A note with a home
    goes there, to a point; others go where their marker first stands in a block."""
    text = F.coalesce("text", F.lit(""))
    b = blocks.select("doc_id", F.col("bi").cast("long").alias("bi"), text.alias("text"))
    asked = notes.select("doc_id", "note_id", _bare(F.col("marker")).alias("marker"), F.col("home").cast("long").alias("home"), F.col("at").cast("int").alias("at"))
    n = F.length("text")
    point = F.greatest(F.lit(0), F.least(n, F.coalesce("at", F.lit(0))))
    pinned = asked.where("home is not null").join(b.withColumnRenamed("bi", "home"), ["doc_id", "home"]).select("doc_id", "note_id", F.col("home").alias("bi"), point.alias("start"), point.alias("stop"))
    key = F.when(F.col("marker").rlike(_DIGITS), F.col("marker")).otherwise(F.substring("marker", 1, 1))
    searched = asked.where("home is null and marker <> ''").withColumn("key", key)
    found = b.select("doc_id", "bi", F.explode(_keys(F.col("text"))).alias("key"))
    pairs = found.join(searched.select("doc_id", "key", "note_id", "marker"), ["doc_id", "key"]).select("doc_id", "bi", "note_id", "marker")
    parts = F.split("text", marker_pattern(F.col("marker")), 2)
    start = F.length(F.get(parts, F.lit(0)))
    size = n - start - F.length(F.get(parts, F.lit(1)))
    met = pairs.join(b, ["doc_id", "bi"]).where(F.size(parts) == 2).select("doc_id", "note_id", "bi", start.alias("start"), (start + size).alias("stop"))
    return pinned.unionByName(met)


def _taken(hits: Column) -> Column:
    """The hits of one block that get their place: in order, those that begin behind the last that got one."""

    def step(s: Column, h: Column) -> Column:
        free = h["start"] >= s["reach"]
        return F.when(free, F.struct(h["stop"].alias("reach"), F.concat(s["ids"], F.array(h["note_id"])).alias("ids"))).otherwise(s)

    return F.aggregate(hits, F.struct(F.lit(0).alias("reach"), F.array().cast("array<string>").alias("ids")), step, lambda s: s["ids"])


def settled(candidates: DataFrame) -> DataFrame:
    """doc_id, note_id, bi, start, stop: the one place of each note that has any.

    Blocks fill up in reading order, from the top of each block; of two places that overlap the second note waits for a later
    block. In each round a document's blocks are settled up to the first where a note has to wait, so that only
    documents with such a block, and only what lies behind it, need another round.
    """
    hit = F.struct("start", (F.col("stop") - F.col("start")).alias("width"), "note_id", "stop")
    left, done = scratch.keep(candidates), None
    while True:
        first = left.groupBy("doc_id", "note_id").agg(F.min_by(F.struct("bi", "start", "stop"), "bi").alias("p")).select("doc_id", "note_id", "p.*")
        filled = first.groupBy("doc_id", "bi").agg(_taken(F.array_sort(F.collect_list(hit))).alias("ids"), F.collect_list("note_id").alias("all"))
        filled = scratch.keep(filled.withColumn("waits", F.size("ids") < F.size("all")))
        ends = scratch.keep(filled.where("waits").groupBy("doc_id").agg(F.min("bi").alias("end")))
        taken = filled.join(ends, "doc_id", "left").where("end is null or bi <= end").select("doc_id", "bi", F.explode("ids").alias("note_id"))
        now = scratch.keep(first.join(taken, ["doc_id", "bi", "note_id"]).select("doc_id", "note_id", "bi", "start", "stop"))
        done = now if done is None else done.unionByName(now)
        if ends.isEmpty():
            return done
        behind = left.join(ends, "doc_id").where("bi > end").drop("end").join(now.select("doc_id", "note_id"), ["doc_id", "note_id"], "left_anti")
        old, left = left, scratch.keep(behind)
        scratch.drop(old)


def prepare(blocks: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, note_id, mark, bi, word_index of each note (doc_id, note_id, marker, home, at); mark is null for orphans.

    Marks count up in reading order; a note's word is the last before it once the printed markers are gone.
    """
    found = scratch.keep(settled(places(blocks, notes)))
    order = F.struct("start", (F.col("stop") - F.col("start")).alias("width"), "note_id", "stop")
    per = found.groupBy("doc_id", "bi").agg(F.array_sort(F.collect_list(order)).alias("hits")).join(blocks.select("doc_id", F.col("bi").cast("long").alias("bi"), "text"), ["doc_id", "bi"])

    def step(s: Column, h: Column) -> Column:
        out = F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, h["start"] - s["at"]))
        word = F.greatest(F.lit(0), F.size(F.filter(F.split(out, f"{BLANK}+"), lambda w: w != "")) - 1)
        row = F.struct(h["note_id"].alias("note_id"), h["start"].alias("start"), h["width"].alias("width"), word.alias("word"))
        return F.struct(out.alias("out"), h["stop"].alias("at"), F.concat(s["rows"], F.array(row)).alias("rows"))

    kind = "array<struct<note_id:string,start:int,width:int,word:int>>"
    rows = F.aggregate("hits", F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.array().cast(kind).alias("rows")), step, lambda s: s["rows"])
    placed = per.select("doc_id", "bi", F.inline(rows))
    reading = Window.partitionBy("doc_id").orderBy("bi", "start", "width", "note_id")
    placed = placed.select("doc_id", "note_id", F.row_number().over(reading).alias("mark"), "bi", F.col("word").alias("word_index"))
    return notes.select("doc_id", "note_id").join(placed, ["doc_id", "note_id"], "left").select("doc_id", "note_id", "mark", "bi", "word_index")
