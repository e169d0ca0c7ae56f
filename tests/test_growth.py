"""Work, shuffles and memory of a task that follow the input: nothing meets all that is like it, no task takes a share that grows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leafmill import registry
from leafmill.functions import markup, text
from leafmill.operators import lexicon, quality, runs
from leafmill.plans import views
from leafmill.queries import stored
from leafmill.sources import files


def test_a_run_is_looked_up_once_for_all_of_a_name_and_size(spark):
    n = 40_000
    stored = spark.range(n).select(F.lit("a").alias("name"), F.lit(1).alias("size"), F.format_string("k%05d", "id").alias("key"))
    wanted = stored.select(F.col("key").alias("want_id"), "name", "size", F.when(F.col("key") == "k00007", F.col("key")).otherwise("none").alias("key"))
    began = time.time()
    got = {r.key: r.n for r in runs.find_run(wanted, stored.union(stored.limit(9))).groupBy("key").agg(F.count("*").alias("n")).collect()}
    assert got == {"k00000": n - 1, "k00007": 1}
    assert time.time() - began < 30  # 1.6 thousand million pairs take longer


@pytest.fixture
def small_shares(monkeypatch):
    monkeypatch.setattr(views, "SHARE", 1000)


def test_tasks_grow_with_the_text(spark, small_shares):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word, Word 12 "), 20).alias("text"))
    assert views.dealt(docs).rdd.getNumPartitions() == 60 * 280 // 1000 + 1
    assert views.dealt(docs.where("false")).count() == 0
    assert quality.assess(docs).rdd.getNumPartitions() >= 17


def shuffles(df):
    """The shuffles of a plan before it runs, but for those that deal texts out."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "REPARTITION_BY_NUM" not in line and "Broadcast" not in line for line in plan.splitlines())


@pytest.mark.parametrize("name", ["w06_spot_names", "w06_healed_lines", "s05_flatten_words"])
def test_words_are_not_shuffled(spark, name):
    assert shuffles(registry.queries()[name](spark, "/root/testdata/sf0.001")) == 0


def test_pages_are_checked_once(spark):
    """A page's findings are summed up where they are made, not made again, joined and grouped."""
    plan = registry.queries()["j01_verified_pages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_long_titles_become_file_names_fast(spark):
    titles = spark.range(20_000).select(F.concat(F.lit("É½ "), F.repeat(F.lit("Straße 7, "), 100)).alias("t"))
    began = time.time()
    assert [r.f for r in titles.select(text.safe_file_name(F.col("t"), "pdf").alias("f")).distinct().collect()] == [("e1-2-" + "stra-e-7-" * 9)[:60] + ".pdf"]
    assert time.time() - began < 25  # twenty million signs


def test_words_are_counted_without_sorting_all(spark):
    """Least places of all words' spellings as structs would be sorted for; only those of different ones may be."""
    at = F.struct(F.col("id").alias("doc"), (F.col("id") % 7).alias("pos"))
    words = spark.range(100).select(F.lit("Word").alias("text"), F.lit(50).cast("long").alias("confidence"), at.alias("at"))
    spelled = lexicon.forms(words)
    assert [(r.n, r["first"].doc, r["first"].pos) for r in spelled.collect()] == [(100, 0, 0)]
    lines = [line for line in spelled._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate(" in line]
    assert "HashAggregate" in lines[-1] and "HashAggregate" in lines[-2]  # those right above the words


def test_archives_are_bound_and_read_a_few_at_a_time(spark, small_shares):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0]
    assert stored._archives(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == size // 1000 + 1
    row = lambda k, n: ("a", "page", k, "p", None, b"x" * n, None)
    big = list(files.batches(row(k, files.BATCH // 2) for k in range(5)))
    assert [b.num_rows for b in big] == [2, 2, 1] and big[2].column("page").to_pylist() == [4]
    assert [b.num_rows for b in files.batches(row(k, 1) for k in range(files.ROWS + 1))] == [files.ROWS, 1]
    assert list(files.batches(iter([]))) == []


def test_scans_are_written_and_read_where_their_texts_lie(spark):
    assert shuffles(registry.queries()["s01_parse_hocr"](spark, "/root/testdata/sf0.001")) == 0


def test_emphasis_takes_time_by_the_word(spark):
    n = 60_000
    rows = spark.range(1).select(F.concat(F.lit("<em>"), F.repeat(F.lit("ab "), n), F.lit("</em>")).alias("raw"))
    began = time.time()
    read = rows.select(markup.parsed_markup(F.col("raw")).alias("m")).localCheckpoint()
    got = read.select(F.size("m.emphasis").alias("n"), markup.with_markup(F.col("m.text"), F.col("m.emphasis")).alias("t")).first()
    assert got.n == n and got.t == "<i>" + ("ab " * n).rstrip() + "</i> "
    assert time.time() - began < 20  # thousands of millions of copied places take longer


def test_stored_edits_are_parsed_once_and_their_fields_read_once(spark):
    plan = registry.queries()["s23_edit_log"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1
    assert not [line for line in plan.splitlines() if "Filter" in line.split("(")[0] and "variant" in line]


@pytest.mark.parametrize("name", ["w06_dropped_runs", "w06_spliced_readings", "w06_scanned_runs"])
def test_readings_are_compared_where_their_texts_lie(spark, name):
    """Texts are dealt out once for both readings, and no word is sorted, grouped or joined."""
    df = registry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert shuffles(df) == 0 and plan.count("REPARTITION_BY_NUM") == 1 and "Sort" not in plan and "Join" not in plan


def test_texts_are_read_once_for_a_lexicon(spark):
    """Spellings and the documents that have a word come from one pass and one shuffle, and folding starts from what that has found."""
    sf = "/root/testdata/sf0.001"
    entries = registry.queries()["a01_lexicon_entries"](spark, sf)
    plan = entries._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Join" not in plan and shuffles(entries) == 1
    assert "documents.parquet" not in registry.queries()["a01_lexicon_folded"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_keys_without_a_letter_are_never_sent_whole_to_all(spark):
    keys = spark.createDataFrame([("and",), ("ant",), ("at",), ("bat",)], "key string")
    pairs = lexicon.neighbours(keys)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == [("and", "ant"), ("ant", "at")]


def test_words_are_counted_in_arrays_as_in_rows(spark):
    odd = ["\u00a0", "\ufeff", "\x0b", "\x1c", "\x85", "\u2009\n", " \u3000 ", "\t"]
    bricks = ["Über", "über,", "(ÜBER)", "naïve", "ſaith", "a1", "42", "--", "it", "It's", "ye", "bodies", "Bodies.", "œuvre", "x-y", "«et»", "est"]
    rng = random.Random(5)
    rows = [(k % 17, "".join(rng.choice(bricks) + rng.choice(odd + [" "] * 9) for _ in range(rng.randrange(60)))) for k in range(60)]
    rows += [(40, None), (41, ""), (42, " \u00a0"), (43, " it \n"), (5, None)]
    docs = views.dealt(spark.createDataFrame(rows, "doc_id long, text string")).persist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    words = views.ocr_words(views.tokens(docs)).withColumn("at", F.struct(F.col("doc_id").alias("doc"), "pos"))
    shown = lambda df: sorted((*r[:3], round(r[3], 9), *r[4:7], tuple(r[7])) for r in df.collect())
    try:
        for share in (0.05, 0.2, 0.25, 2):
            want = shown(lexicon.entries(words, lexicon.widespread(views.tokens(docs), len(rows), share)))
            got = lexicon.entries_of_texts(docs, views.scanned_confidence, len(rows), share)
            assert shown(got.select("key", "term", "count", "mean_confidence", "known", "archaic", "proper", "signals")) == want
        assert want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
