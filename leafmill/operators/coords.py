"""Words by place: point, interval and neighbourhood queries on boxes, joined on a grid so that no pair is tried in vain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import area

CELL = 128


def _cells(a, b, cell: int):
    return F.sequence(F.floor(a / cell), F.floor(b / cell))


def at_point(boxes: DataFrame, points: DataFrame, cell: int = CELL) -> DataFrame:
    """point_id, pos of the smallest box (first of equals) that holds each point on its page, edges included.

    Boxes (doc_id, page_index, pos, x0, y0, x1, y1) are dealt to the grid cells that they touch, a point to its own.
    """
    dealt = boxes.withColumn("cx", F.explode(_cells(F.col("x0"), F.col("x1"), cell))).withColumn("cy", F.explode(_cells(F.col("y0"), F.col("y1"), cell)))
    spots = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    hit = spots.join(dealt, ["doc_id", "page_index", "cx", "cy"]).where("x between x0 and x1 and y between y0 and y1")
    size = area(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    return hit.groupBy("point_id").agg(F.min(F.struct(size.alias("size"), F.col("pos"))).alias("m")).select("point_id", "m.pos")


def ranges(tok: DataFrame) -> DataFrame:
    """doc_id, pos, start, stop: each token's characters in the text that its document's tokens make, one blank between."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    stop = F.sum(F.length("token") + 1).over(order) - 1
    return tok.select("doc_id", "pos", (stop - F.length("token")).alias("start"), stop.alias("stop"))


def at_offset(spans: DataFrame, offsets: DataFrame, cell: int = 64) -> DataFrame:
    """query_id, pos of the last span [start, stop) that holds each offset."""
    dealt = spans.where("stop > start").withColumn("c", F.explode(_cells(F.col("start"), F.col("stop") - 1, cell)))
    hit = offsets.withColumn("c", F.floor(F.col("offset") / cell)).join(dealt, ["doc_id", "c"]).where("offset >= start and offset < stop")
    return hit.groupBy("query_id").agg(F.max(F.struct("start", "stop", "pos")).alias("m")).select("query_id", "m.pos")


def in_range(spans: DataFrame, wanted: DataFrame, cell: int = 64) -> DataFrame:
    """query_id, n, first, last: the spans that each range [a, b) overlaps."""
    dealt = spans.where("stop > start").withColumn("c", F.explode(_cells(F.col("start"), F.col("stop") - 1, cell)))
    asked = wanted.where("b > a").withColumn("c", F.explode(_cells(F.col("a"), F.col("b") - 1, cell)))
    hit = asked.join(dealt, ["doc_id", "c"]).where("start < b and a < stop").select("query_id", "pos").distinct()
    return hit.groupBy("query_id").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def context_boxes(words: DataFrame, reach: int = 4, pad: int = 6) -> DataFrame:
    """doc_id, pos and the box around a word and its ``reach`` neighbours either side on its line.

    Words of a line share their page and, on this grid, their top; a line holds few words.
    """
    line = Window.partitionBy("doc_id", "page_index", "y0").orderBy("x0", "pos").rowsBetween(-reach, reach)
    return words.select(
        "doc_id", "pos", (F.min("x0").over(line) - pad).alias("x0"), (F.min("y0").over(line) - pad).alias("y0"),
        (F.max("x1").over(line) + pad).alias("x1"), (F.max("y1").over(line) + pad).alias("y1"),
    )


def same_line_pairs(words: DataFrame) -> DataFrame:
    """doc_id, page_index, n: neighbouring words whose boxes overlap by half the shorter's height."""
    order = Window.partitionBy("doc_id", "page_index").orderBy("pos")
    both = words.withColumn("p0", F.lag("y0").over(order)).withColumn("p1", F.lag("y1").over(order))
    shared = F.least("y1", "p1") - F.greatest("y0", "p0")
    same = (shared > 0) & (shared >= F.least(F.col("y1") - F.col("y0"), F.col("p1") - F.col("p0")) * 0.5)
    return both.groupBy("doc_id", "page_index").agg(F.count_if(same).alias("n"))


def flags(words: DataFrame, threshold: int = 60) -> DataFrame:
    return words.where(F.col("confidence") < threshold)


def union_boxes(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id", "page_index").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
