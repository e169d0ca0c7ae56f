"""Logs of long runs: results, tickets, edits, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLLAPSIBLE = ["note", "image", "section", "retouch", "anchor", "text", "retype"]


def halts(events: DataFrame, limit: int = 3) -> DataFrame:
    """user_id, stop_at: the place of the first event that makes ``limit`` equal failures in a row (user_id, ts, event_id, message)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = events.withColumn("n", F.row_number().over(order))
    same = F.col("message").eqNullSafe(F.lag("message").over(order))
    island = F.sum((~same).cast("int")).over(order)
    runs = n.withColumn("island", island).where(F.col("message").isNotNull())
    place = F.row_number().over(Window.partitionBy("user_id", "island").orderBy("n"))
    return runs.withColumn("place", place).where(F.col("place") == limit).groupBy("user_id").agg(F.min("n").cast("long").alias("stop_at"))


def upserts(edits: DataFrame) -> DataFrame:
    """What is left of an edit log (book, seq, kind, target): of a replaceable kind the last edit of a target; all others."""
    kind = F.col("kind").isin(COLLAPSIBLE)
    last = edits.where(kind).groupBy("book", "kind", "target").agg(F.max("seq").alias("seq"))
    return last.select("book", "seq", "kind", "target").union(edits.where(~kind).select("book", "seq", "kind", "target"))


def retained(rows: DataFrame, key: list[str], newest: list, keep: int) -> DataFrame:
    """The ``keep`` newest rows of each key."""
    order = Window.partitionBy(*key).orderBy(*newest)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).drop("_r")


RESULT = "custom_id string, type string, error string, input long, output long, _bad string"


def parse_results(lines: DataFrame) -> DataFrame:
    """page, ok, reason, input, output from JSON lines (line); lines that don't parse are dropped, unknown ids have no page."""
    parsed = lines.select(F.from_json("line", RESULT, {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*").where("_bad is null and custom_id is not null")
    page = F.when(F.col("custom_id").rlike(r"^page-\d{1,9}$"), F.regexp_extract("custom_id", r"(\d+)$", 1).cast("long"))
    reason = F.when(F.col("type") != "succeeded", F.coalesce("error", F.concat(F.lit("the request "), F.col("type"))))
    return parsed.select("custom_id", page.alias("page"), (F.col("type") == "succeeded").alias("ok"), reason.alias("reason"), F.coalesce("input", F.lit(0)).alias("input"), F.coalesce("output", F.lit(0)).alias("output"))


def missing(expected: DataFrame, results: DataFrame) -> DataFrame:
    """The expected pages of which no result, good or bad, came back."""
    return expected.join(results.where("page is not null").select("page"), "page", "left_anti")


def resume_from(rows: DataFrame) -> DataFrame:
    """Where to go on: pages done, within the count, if version, dpi and most pages (null equals null) are as wanted."""
    same = F.col("version").eqNullSafe(F.col("want_version")) & F.col("dpi").eqNullSafe(F.col("want_dpi")) & F.col("most").eqNullSafe(F.col("want_most"))
    at = F.when(same, F.least("page_count", F.greatest(F.lit(0), "done"))).otherwise(0)
    return rows.withColumn("resume", at).withColumn("usable", same & (F.col("page_count") > 0) & (F.col("done") >= F.col("page_count")))


def find_run(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """want_id, key: the stored run of the same key, else the first of the same name and size.

    Only the first of a name and size can be an answer, so that no wanted run meets all that are alike.
    """
    exact = wanted.join(stored.select("key").distinct(), "key").select("want_id", F.lit(0).alias("rank"), "key")
    firsts = stored.groupBy("name", "size").agg(F.min("key").alias("key"))
    same = wanted.select("want_id", "name", "size").join(firsts, ["name", "size"]).select("want_id", F.lit(1).alias("rank"), "key")
    return exact.union(same).groupBy("want_id").agg(F.min(F.struct("rank", "key")).alias("m")).select("want_id", "m.key")


def settled(findings: DataFrame, spots: DataFrame, uncertain: DataFrame) -> DataFrame:
    """Pages all of whose findings above low are dropped text, with spots, each judged not there, and nothing uncertain."""
    only = findings.where("severity <> 'low'").groupBy("page").agg(F.bool_and(F.col("code") == "text-dropped").alias("only")).where("only")
    judged = spots.groupBy("page").agg(F.bool_and(F.coalesce(F.col("verdict") == "not-there", F.lit(False))).alias("all")).where("all")
    return only.select("page").join(judged.select("page"), "page").join(uncertain.select("page").distinct(), "page", "left_anti")
