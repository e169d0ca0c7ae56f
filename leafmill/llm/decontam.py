"""Passages of benchmark items found in documents, by winnowing.

Words are runs of digits, letters and all signs beyond ASCII, with A-Z in lower case. A window is ``span`` neighbouring
words of an item; an item of fewer words is one window of them all. For windows of L words a fingerprint is the hash of
``gram`` words (L, if fewer), and each window keeps the least of its fingerprints: windows that are equal keep the same
one, so every shared window is found. Neighbouring windows that keep one fingerprint are one row, with the words from the
first of these windows to the end of the last.

Rows of documents whose fingerprint no item keeps go, by a semi join. What is left is extended over its words, both ways
from the fingerprint to the ends of the windows that kept it: each window is joined with the items' different windows,
as text. Windows that overlap or touch add up to the whole shared span. No document meets an item on a fingerprint
alone, so a common phrase costs a row a place and no pairs. Items are looked up once a set of windows that a document
has, not once a document: copies of a passage share their set.

Null texts and texts without words have no windows. Very long texts are rows like others. Rows that repeat doc_id and
text are the same document and get the same result; a null doc_id is an id like others. Items that repeat item_id and
windows count once; an item whose item_id is null hits words but isn't listed. An empty table on either side gives no
hits. Other columns aren't read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SPAN, GRAM = 10, 5

#: Fixed value: the signs that make a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(_lowered(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def fingerprints(df: DataFrame, keys: list[str], length: Column, gram: int) -> DataFrame:
    """keys, len, mark, lo, near: the least fingerprint ``mark`` of some neighbouring windows of ``length`` words of the
    array ``words``, the first of these windows (from 1) and the words from there to the end of the last window."""
    upto = lambda of, n: F.when(F.size(of) >= n, F.sequence(F.lit(1), F.size(of) - n + 1)).otherwise(F.array().cast("array<int>"))
    df = df.select(*keys, "words", length.cast("int").alias("len"))
    k = F.least(F.lit(gram), F.col("len"))
    df = df.withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))
    df = df.withColumn("h", F.transform(upto("h", k), lambda i: F.xxhash64(F.slice("h", i, k))))
    wide = F.col("len") - k + 1
    df = df.withColumn("h", F.transform(upto("h", wide), lambda i: F.array_min(F.slice("h", i, wide))))
    new = F.filter(upto("h", 1), lambda i: F.coalesce(F.get("h", i - 1) != F.get("h", i - 2), F.lit(True)))
    df = df.withColumn("new", new)

    def row(i, j):
        to = F.coalesce(F.get("new", j + 1) - 1, F.size("h"))
        return F.struct(F.get("h", i - 1).alias("mark"), i.alias("lo"), F.slice("words", i, to - i + F.col("len")).alias("near"))

    return df.select(*keys, "len", F.inline(F.transform("new", row)))


def _windows(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, at (the window's first word, from 1), len and the window's words in one string."""
    n = F.col("len")
    each = F.transform(F.sequence(F.lit(1), F.size("near") - n + 1), lambda i: F.struct((F.col("lo") + i - 1).alias("at"), F.array_join(F.slice("near", i, n), " ").alias("window")))
    return rows.select(*keys, "len", F.inline(each))


def item_windows(scratch: Scratch, items: DataFrame, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: (item_id, len, window, wid) and the different (len, mark) that items keep."""
    worded = items.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    rows = scratch.keep(fingerprints(worded, ["item_id"], F.least(F.size("words"), F.lit(span)), gram), "items")
    windows = _windows(rows, "item_id").select("item_id", "len", "window").distinct()
    return scratch.keep(windows.withColumn("wid", F.xxhash64("len", "window")), "windows"), scratch.keep(rows.select("len", "mark").distinct(), "marks")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and k, th by which equal rows are one."""
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"))


def hits(scratch: Scratch, docs: DataFrame, windows: DataFrame, marks: DataFrame, gram: int = GRAM) -> DataFrame:
    """k, th, at, len, wid: where the items' windows lie in the documents of ``keyed``, from word 1."""
    # At most as many lengths as a window has words: one number each.
    lengths = sorted(r["len"] for r in marks.select("len").distinct().collect())
    worded = docs.select("k", "th", _words(F.col("text")).alias("words"))
    found = None
    for n in lengths:
        rows = fingerprints(worded, ["k", "th"], F.lit(n), gram)
        rows = rows.join(marks.where(F.col("len") == n).select("mark"), "mark", "left_semi")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return docs.sparkSession.createDataFrame([], "k long, th long, at int, len int, wid long")
    # Written, so that both sides of the next join are plain shuffles, which Spark can split where a key is hot.
    found = scratch.keep(_windows(found, "k", "th").select("k", "th", "at", "len", "window"), "candidates")
    kinds = scratch.keep(windows.select("len", "window", "wid").distinct(), "kinds")
    return scratch.keep(found.join(kinds, ["len", "window"]).select("k", "th", "at", "len", "wid"), "hits")


def spans(found: DataFrame) -> DataFrame:
    """k, th, lo, hi: the words of each document (from 1) that hits cover without a break."""
    ends = found.groupBy("k", "th", "at").agg(F.max(F.col("at") + F.col("len") - 1).alias("to"))
    order = Window.partitionBy("k", "th").orderBy("at")
    reached = F.coalesce(F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    marked = ends.withColumn("new", (F.col("at") > reached + 1).cast("int")).withColumn("run", F.sum("new").over(order))
    return marked.groupBy("k", "th", "run").agg(F.min("at").alias("lo"), F.max("to").alias("hi")).drop("run")


def _listed(found: DataFrame, windows: DataFrame) -> DataFrame:
    """k, th, n_items, items: the item ids, as strings in order, of each document with hits."""
    sets = found.groupBy("k", "th").agg(F.array_sort(F.collect_set("wid")).alias("wids")).withColumn("name", F.sha2(F.array_join("wids", ","), 256))
    each = sets.dropDuplicates(["name"]).select("name", F.explode("wids").alias("wid"))
    named = each.join(windows.where("item_id is not null").select("wid", F.col("item_id").cast("string").alias("item_id")), "wid").select("name", "item_id").distinct()
    lists = named.groupBy("name").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return sets.select("k", "th", "name").join(lists, "name").select("k", "th", "items")


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, spans (array of lo, hi: words from 1, in order), items (ids as strings, in order)."""
    scratch = Scratch(docs.sparkSession)
    docs = keyed(docs)
    windows, marks = item_windows(scratch, items, span, gram)
    found = hits(scratch, docs, windows, marks, gram)
    covered = spans(found).groupBy("k", "th").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n_hit"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    per = scratch.keep(covered.join(_listed(found, windows), ["k", "th"], "left"), "contaminated")
    counted = docs.select("doc_id", "k", "th", F.coalesce(F.regexp_count(_lowered(F.col("text")), F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.join(per, ["k", "th"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<lo:int,hi:int>>")).alias("spans"), F.coalesce("items", none).alias("items"),
    )


def digest(report: DataFrame) -> DataFrame:
    return report.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
with doc as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents
), item as (
  select item_id, w, least(10, len(w)) n from (
    select item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from benchmark) where len(w) > 0
), item_windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') x from (select *, unnest(range(1, len(w) - n + 2)) i from item)
), found as (
  select distinct doc_id, d.i, d.n, item_id from (
    select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') x from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from doc, (select distinct n from item) where len(w) >= n)) d
  join item_windows using (n, x)
), hit as (
  select doc_id, count(distinct i + k) n_hit from (select doc_id, i, unnest(range(0, n)) k from found) group by doc_id
), listed as (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, item_id::varchar item from found) group by doc_id
)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from doc left join hit using (doc_id) left join listed using (doc_id)
"""
