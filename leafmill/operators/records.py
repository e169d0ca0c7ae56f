"""Saved records: nested tickets, checkpoints, answers and profiles read with their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a second reader may say of a spot.
VERDICTS = ["present", "not-there", "unclear"]


def is_figure_column(values: Column) -> Column:
    """Whether every filled cell has a digit and no letter; no filled cell: no."""
    filled = F.filter(values, lambda v: F.trim(v) != "")
    return (F.size(filled) > 0) & F.forall(filled, lambda v: v.rlike(r"\p{N}") & ~v.rlike(r"\p{L}"))


def normalize_table(cells: Column) -> Column:
    """Rows with anything in them."""
    return F.filter(cells, lambda row: F.exists(row, lambda c: F.trim(c) != ""))


def looks_scanned(pages: DataFrame, most: int = 8, share: float = 0.66) -> DataFrame:
    """doc_id, sampled, scanned, mean_text: a verdict from at most ``most`` pages, evenly apart (covered: 0 to 1)."""
    doc = Window.partitionBy("doc_id")
    n = F.count("*").over(doc)
    step = F.greatest(F.lit(1), F.floor(n / F.least(F.lit(most), n)))
    taken = pages.withColumn("step", step).where((F.col("page_index") % F.col("step") == 0) & (F.floor(F.col("page_index") / F.col("step")) < most))
    out = taken.groupBy("doc_id").agg(F.count("*").alias("sampled"), F.count_if(F.col("covered") >= share).alias("full"), F.avg("text_length").alias("mean_text"))
    return out.select("doc_id", "sampled", (F.col("full") * 2 > F.col("sampled")).alias("scanned"), "mean_text")


def ticket_summary(tickets: DataFrame, days: int = 29) -> DataFrame:
    """Of each ticket (ticket_id, submitted, batches: array of pages, collected): pages in order, counts, pending, expiry."""
    every = F.sort_array(F.array_distinct(F.flatten(F.transform("batches", lambda b: b["pages"]))))
    pending = F.filter("batches", lambda b: ~F.coalesce(b["collected"], F.lit(False)))
    return tickets.select(
        "ticket_id", every.alias("pages"), F.size("batches").alias("n_batches"), F.size(pending).alias("n_pending"), (F.col("submitted") + F.expr(f"interval {days} days")).alias("expires")
    )


def checkpoint_left(checkpoints: DataFrame) -> DataFrame:
    """Of each checkpoint (id, done, total, failed: array) the chunks read, those left, and the one reason, if only one."""
    read = F.array_except(F.when(F.col("done") > 0, F.sequence(F.lit(0), F.col("done") - 1)).otherwise(F.array().cast("array<int>")), F.transform("failed", lambda f: f["chunk"]))
    reasons = F.array_distinct(F.transform("failed", lambda f: f["message"]))
    return checkpoints.select(
        "id", F.size(read).alias("n_read"), (F.col("total") - F.size(read)).alias("n_left"), F.when(F.size(reasons) == 1, F.get(reasons, 0)).alias("failed_because"),
        ((F.col("total") > 0) & (F.col("done") >= F.col("total")) & (F.size("failed") == 0)).alias("complete"),
    )


def adjudications(answers: DataFrame, asked: DataFrame) -> DataFrame:
    """spot_id, verdict, reading: the first valid answer (spot_id, pos, verdict, reading) to each asked spot; what isn't there has no reading."""
    good = answers.where(F.col("verdict").isin(VERDICTS)).join(asked.select("spot_id").distinct(), "spot_id", "left_semi")
    first = good.groupBy("spot_id").agg(F.min_by(F.struct("verdict", "reading"), "pos").alias("a"))
    return first.select("spot_id", "a.verdict", F.when(F.col("a.verdict") == "not-there", "").otherwise(F.coalesce("a.reading", F.lit(""))).alias("reading"))


def prune_answers(answers: DataFrame, options: DataFrame, questions: DataFrame) -> DataFrame:
    """``answers`` (run, question, value) without choices that their question no longer offers; unknown questions stay."""
    known = answers.join(questions.select("question").distinct().withColumn("asked", F.lit(True)), "question", "left")
    offered = options.select("question", "value").distinct().withColumn("offered", F.lit(True))
    return known.join(offered, ["question", "value"], "left").where("asked is null or offered").select("run", "question", "value")


def missing_required(answers: DataFrame, questions: DataFrame, runs: DataFrame) -> DataFrame:
    """run, question of the required questions (question, required) without a filled answer."""
    wanted = questions.where("required").select("question").agg(F.collect_set("question").alias("q"))  # a form's questions: few
    filled = answers.where(F.trim("value") != "").select("run", "question").distinct()
    every = runs.select("run").distinct().withColumn("question", F.explode(F.array(*[F.lit(q) for q in wanted.first()["q"]])))
    return every.join(filled, ["run", "question"], "left_anti")


def merge_style(base: Column, patch: Column, fields: list[str]) -> Column:
    """A patch's set fields over a base's."""
    return F.struct(*[F.coalesce(patch[f], base[f]).alias(f) for f in fields])


def question_groups(questions: DataFrame) -> DataFrame:
    """form, group_no, name, questions: named groups gather wherever they stand, loose neighbours make a group; in order
    of first appearance (form, pos, question, name)."""
    order = Window.partitionBy("form").orderBy("pos")
    loose = F.sum((F.lag("name").over(order).isNotNull() | F.lag("pos").over(order).isNull()).cast("int")).over(order)
    tagged = questions.withColumn("tag", F.coalesce(F.concat(F.lit("n:"), F.col("name")), F.concat(F.lit("l:"), loose.cast("string"))))
    groups = tagged.groupBy("form", "tag").agg(F.min("pos").alias("first"), F.max("name").alias("name"), F.array_sort(F.collect_list(F.struct("pos", "question"))).alias("q"))
    return groups.select("form", F.row_number().over(Window.partitionBy("form").orderBy("first")).alias("group_no"), "name", F.transform("q", lambda x: x["question"]).alias("questions"))
