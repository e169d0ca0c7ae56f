"""Roles of pages, and what they decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What becomes of a page's text; any other role is transcribed.
DISPOSITIONS = {
    "half-title": "extract-metadata", "title-page": "extract-metadata", "copyright": "extract-metadata",
    "table-of-contents": "discard", "list-of-illustrations": "discard", "index": "discard", "blank": "discard",
    "dedication": "transcribe-aside", "epigraph": "transcribe-aside", "colophon": "transcribe-aside",
}
FRONT = ["half-title", "title-page", "copyright", "dedication", "epigraph", "preface", "table-of-contents", "list-of-illustrations"]
ALL = ["transcribe", "extract-metadata", "discard", "transcribe-aside"]


def disposition(role: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for pair in DISPOSITIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, role), F.lit("transcribe"))


def is_front(role: Column) -> Column:
    return role.isin(FRONT)


def partition(pages: DataFrame) -> DataFrame:
    """book and, per disposition, its page indices in order; an empty list where there are none."""
    kept = pages.withColumn("d", disposition(F.col("role")))
    return kept.groupBy("book").agg(
        *(F.sort_array(F.collect_list(F.when(F.col("d") == d, F.col("page_index")))).alias(d.replace("-", "_")) for d in ALL)
    )


def furniture(pages: DataFrame) -> DataFrame:
    """``pages`` with a running head and a folio, each missing by turns."""
    return pages.withColumn("running_head", F.when(F.col("doc_id") % 13 != 0, F.upper("source"))).withColumn(
        "folio", F.when(F.col("doc_id") % 17 != 0, (F.col("page_index") + 1).cast("string"))
    )


def stripped_furniture(pages: DataFrame) -> DataFrame:
    """book, its different running heads in order, and how many pages have a folio."""
    return pages.groupBy("book").agg(F.sort_array(F.collect_set("running_head")).alias("heads"), F.count("folio").alias("folios"))
