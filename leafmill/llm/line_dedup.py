"""Removal of repeated runs of lines by winnowing over line hashes.

A fingerprint is the hash of ``gram`` neighbouring lines. Of each window of ``window`` fingerprints the smallest
(leftmost of equals) is selected, and only selected positions are rows: each has the hashes of the lines that the windows
which selected it reach, before and after. Equal runs of ``gram + window - 1`` lines select alike, so a run whose
fingerprint occurs once is unique and its position goes. Positions of the others are joined on the fingerprint and
extended both ways over these line hashes to the runs they stand for; the first of equal runs in (doc_id, line) order is
the original. Later runs that touch or overlap are one, which extends a match to its whole length, and are deleted: a
line goes if a run of ``gram + window - 1`` lines that covers it also starts earlier, in a smaller doc_id or further up.

With ``words`` a shorter run of at least so many words, down to a single line, is a run as well, its own fingerprint: it
goes if it also starts earlier, whatever its neighbours. Words are what blanks of any kind set apart. Each later copy
that goes has an earlier one that stays.

Lines are split at line feeds and compared as they are. Null text stays null (0 lines), empty text is one empty line;
without ``words`` texts with fewer lines than a run are never changed; a text whose every line goes becomes empty. Very
long texts are rows like others. Rows that repeat doc_id and text are the same document and get the same result; null
ids come first; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, carried, restored

GRAM, WINDOW, WORDS = 2, 2, 50


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        "doc_id", "text", *more, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th")
    )


def _positions(docs: DataFrame, gram: int, window: int, words: int | None) -> DataFrame:
    """k, th, lo, hi, n, mark, near: a selected position's fingerprint ``mark``, first and last window (from line ``lo`` to
    line ``hi``, from 1, of ``n`` lines each) that selected it, and the hashes of the lines from the first to the last."""
    run = gram + window - 1
    lines = docs.select("k", "th", "text", F.split("text", "\n", -1).alias("l")).withColumn("h", F.transform("l", lambda x: F.xxhash64(x)))
    upto = lambda n, of="h": F.when(F.size(of) >= n, F.sequence(F.lit(1), F.size(of) - n + 1)).otherwise(F.array().cast("array<int>"))
    lines = lines.withColumn("g", F.transform(upto(gram), lambda i: F.struct(F.xxhash64(F.slice("h", i, gram)).alias("mark"), i.alias("at"))))
    lines = lines.withColumn("least", F.transform(upto(window, "g"), lambda i: F.array_min(F.slice("g", i, window))))

    def spot(lo, hi, n, mark):
        near = F.slice("h", lo, hi - lo + n)
        return F.struct(lo.alias("lo"), hi.cast("int").alias("hi"), F.lit(n).alias("n"), mark.alias("mark"), near.alias("near"))

    chosen = lambda i: F.get("least", i - 1)  # noqa: E731  of the window from line i
    new = lambda i: F.coalesce(chosen(i)["at"] != chosen(i - 1)["at"], F.lit(True))
    more = lambda i: sum((F.coalesce(chosen(i + d)["at"] == chosen(i)["at"], F.lit(False)).cast("int") for d in range(1, window)), F.lit(0))
    spots = [F.transform(F.filter(upto(1, "least"), new), lambda i: spot(i, i + more(i), run, chosen(i)["mark"]))]
    if words is not None and run > 1:
        # A text of fewer signs than ``words`` words and the blanks between them has no such run: its words aren't counted.
        counts = F.transform("l", lambda x: F.regexp_count(x, F.lit(r"\S+")))
        lines = lines.withColumn("w", F.when(F.length("text") >= 2 * words - 1, counts).otherwise(F.array().cast("array<int>")))
        spots += [_short(n, words, upto, spot) for n in range(1, run)]
    return lines.select("k", "th", F.inline(F.concat(*spots)))


def _short(n: int, words: int, upto, spot) -> Column:
    """The runs of ``n`` lines that hold at least ``words`` words."""
    held = lambda i: F.aggregate(F.slice("w", i, n), F.lit(0), lambda s, c: s + c)
    return F.transform(F.filter(upto(n, "w"), lambda i: held(i) >= words), lambda i: spot(i, i, n, F.xxhash64(F.lit(n), F.slice("h", i, n))))


def repeated_runs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, words: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """k, th, runs (array of first and last line, from 1, in order) of the later copies."""
    scratch = scratch or Scratch(docs.sparkSession)
    positions = _positions(_keyed(docs), gram, window, words)
    shared = positions.groupBy("mark").count().where("count > 1").select("mark")
    joined = scratch.keep(positions.join(shared.hint("shuffle_hash"), "mark", "left_semi").drop("mark"), "positions")
    each = F.transform(F.sequence("lo", "hi"), lambda i: F.struct(i.alias("at"), F.xxhash64("n", F.slice("near", i - F.col("lo") + 1, F.col("n"))).alias("name")))
    windows = joined.select("k", "th", "n", F.inline(each))
    first = windows.groupBy("name").agg(F.min(F.struct("k", "th", "at")).alias("first"), F.count("*").alias("count")).where("count > 1").drop("count")
    later = windows.join(first.hint("shuffle_hash"), "name").where(F.struct("k", "th", "at") > F.col("first"))
    later = later.groupBy("k", "th", "at").agg(F.max(F.col("at") + F.col("n") - 1).alias("to"))
    order = Window.partitionBy("k", "th").orderBy("at")
    reached = F.coalesce(F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    starts = later.withColumn("new", (F.col("at") > reached + 1).cast("int"))
    islands = starts.withColumn("island", F.sum("new").over(order)).groupBy("k", "th", "island")
    runs = islands.agg(F.struct(F.min("at").alias("a"), F.max("to").alias("b")).alias("run"))
    return runs.groupBy("k", "th").agg(F.array_sort(F.collect_list("run")).alias("runs"))


def _rewritten(docs: DataFrame, gram: int, window: int, words: int | None, *more: str) -> DataFrame:
    none = F.array().cast("array<struct<a:int,b:int>>")
    runs = repeated_runs(docs, gram, window, words)
    joined = _keyed(docs, *more).join(runs.hint("shuffle_hash"), ["k", "th"], "left")
    joined = joined.withColumn("runs", F.coalesce("runs", none)).withColumn("lines", F.split("text", "\n", -1))
    last = F.size("lines")
    before = lambda j: F.when(j == 0, 1).otherwise(F.get("runs", j - 1)["b"] + 1)
    until = lambda j: F.coalesce(F.get("runs", j)["a"], last + 1)
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda j: F.slice("lines", before(j), until(j) - before(j))))
    removed = F.aggregate("runs", F.lit(0), lambda s, r: s + r["b"] - r["a"] + 1)
    return joined.select(
        "doc_id",
        F.coalesce(F.when(F.col("text").isNotNull(), last), F.lit(0)).cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.when(F.size("runs") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        *more,
    )


def dedup_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs, text (what is left) of each row."""
    return _rewritten(docs.select("doc_id", "text"), gram, window, words)


def without_repeated_lines(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, words: int | None = WORDS) -> DataFrame:
    """``docs`` with its text so rewritten and n_chars, where there is one, to match."""
    packed, rest = carried(docs)
    return restored(_rewritten(packed, gram, window, words, rest), docs)


ORACLE_SQL = """
with lines as (
  select doc_id, text, string_split(text, chr(10)) l from documents
), windows as (
  select doc_id, unnest(range(1, len(l) - 1)) as pos, l from lines where len(l) >= 3
), named as (
  select doc_id, pos, l[pos] || chr(10) || l[pos + 1] || chr(10) || l[pos + 2] as name from windows
), firsts as (
  select name, min({'d': doc_id, 'p': pos}) f from named group by name having count(*) > 1
), gone as (
  select n.doc_id, n.pos from named n join firsts f on n.name = f.name where {'d': n.doc_id, 'p': n.pos} > f.f
), covered as (
  select distinct doc_id, pos + k as line from gone, (values (0), (1), (2)) t(k)
), runs as (
  select doc_id, count(*) n_removed, count(*) filter (where new) n_runs from (
    select doc_id, line, coalesce(line > lag(line) over (partition by doc_id order by line) + 1, true) new from covered) group by doc_id
), every as (
  select doc_id, unnest(l) line_text, generate_subscripts(l, 1) line from lines
), kept as (
  select e.doc_id, string_agg(line_text, chr(10) order by line) t
  from every e anti join covered c on e.doc_id = c.doc_id and e.line = c.line group by e.doc_id
)
select d.doc_id, coalesce(len(d.l), 0)::bigint n_lines, coalesce(r.n_removed, 0)::bigint n_removed, coalesce(r.n_runs, 0)::bigint n_runs,
       case when d.text is null then null else coalesce(k.t, '') end as text
from lines d left join runs r on d.doc_id = r.doc_id left join kept k on d.doc_id = k.doc_id
"""
