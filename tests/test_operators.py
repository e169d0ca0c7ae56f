import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.functions import markup
from leafmill.functions import text as T
from leafmill.operators import assemble, lexicon, quality, readings, runs
from leafmill.sources import hocr, html


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("v")).first()["v"]


def test_text_functions(spark):
    join = lambda a, b: one(spark, T.join_text(F.col("a"), F.col("b")), a=a, b=b)
    assert join("a run-  ", " ning man") == "a running man" and join("an end.", "A start") == "an end. A start" and join("9-", "10") == "9- 10"
    assert join("soft\xad", "ly") == "softly"
    assert one(spark, T.strip_soft_hyphens(F.col("a")), a="so\xadft") == "soft"
    assert one(spark, T.custom_id(F.col("a")), a=1234567) == "page-1234567" and one(spark, T.custom_id(F.col("a")), a=7) == "page-00007"
    assert one(spark, T.page_of(F.col("a")), a="page-00042x") is None
    assert one(spark, T.edit_distance(F.col("a"), F.col("b")), a="abcd", b="wxyz") == 2
    assert one(spark, T.normalize_token(F.col("a")), a="“don't—”") == "don't"
    assert one(spark, T.collapse(F.col("a")), a=" a\xa0﻿ b　c ") == "a b c"
    assert one(spark, T.parse_table(F.col("a")), a="a | b\n\n c|d ") == [["a", "b"], ["c", "d"]]


def test_quality_counts_and_looks_up_by_different_keys(spark):
    docs = spark.createDataFrame([(1, "'tis 'tis 'tis fine"), (2, None), (3, ""), (4, "— … !!!"), (5, " ".join(["good"] * 250) + " b@d"), (6, " ".join(["wOrd9x"] * 300))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.describe(quality.signals(quality.assess(docs))).collect()}
    assert (got[1].words, got[1].score, got[1].verdict) == (4, 1.0, "mixed")
    assert all(got[k].words == 0 and got[k].score == 0 for k in (2, 3, 4))
    assert got[5].verdict == "trustworthy" and got[5].noise == pytest.approx(1 / 251)
    assert got[6].verdict == "garbage" and "capitals appear inside words" in got[6].signals and got[6].sentence.startswith("This text reads as poor")


def test_assembly_joins_open_paragraphs(spark):
    rows = [(1, 0, "heading", "Title"), (1, 1, "paragraph", "It went on and"), (1, 2, "footnote", "a note"), (1, 3, "paragraph", "on, half-"), (1, 4, "paragraph", "way there."), (1, 5, "paragraph", "the end")]
    got = assemble.assemble(spark.createDataFrame(rows, "doc_id long, bi long, kind string, text string")).orderBy("bi").collect()
    assert [(r.bi, r.n, r.text) for r in got] == [(0, 1, "Title"), (1, 3, "It went on and on, halfway there."), (5, 1, "the end")]


def test_chunks_keep_large_blocks_whole(spark):
    rows = spark.createDataFrame([(1, k, n) for k, n in enumerate([0, 1500, 10, 1190, 1, 0])], "doc_id long, bi long, words long")
    assert [r.chunk for r in assemble.greedy(rows, "words", 1200).orderBy("bi").collect()] == [0, 0, 1, 1, 2, 2]


def test_variants_fold_into_earlier_leaders(spark):
    rng = random.Random(8)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) for _ in range(150)})
    rows = [(k, k.title(), rng.randint(3, 40), 90.0, 0, False, ["frequent-unknown"]) for k in keys]
    found = spark.createDataFrame(rows, "key string, term string, count long, mean_confidence double, archaic int, proper boolean, signals array<string>")

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a[0] != b[0]:
            return False
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            cur = [i]
            for j, y in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
            prev = cur
        return prev[-1] <= 1

    home, heads = {}, []
    for k, _, n, *_ in sorted(rows, key=lambda r: (-r[2], r[0])):
        home[k] = next((h for h in heads if near(h, k)), k)
        if home[k] == k:
            heads.append(k)
    assert {r.key: r.home for r in lexicon.leaders(found).collect()} == home
    folded = {r.key: r for r in lexicon.fold_variants(found).collect()}
    assert set(folded) == set(heads)
    assert sum(r["count"] for r in folded.values()) == sum(r[2] for r in rows)
    assert all(sorted(x.lower() for x in r.variants) == sorted(k for k in home if home[k] == h and k != h) for h, r in folded.items())


def test_markup_round_trip(spark):
    read = lambda t: tuple(one(spark, markup.parsed_markup(F.col("a")), a=t))
    assert read("a <i>b c</i> d</i> <b>e</b> <x>f <em>g") == ("a b c d e <x>f g", [1, 2, 6])
    assert read("<I class=x>one</i>two <cite>🙂 <i>in</i> x</cite>, end") == ("onetwo 🙂 in x, end", [0, 1, 2, 3]) and read("") == ("", []) and read("<i>") == ("", [])
    put = lambda t, e: spark.createDataFrame([(t, e)], "t string, e array<int>").select(markup.with_markup(F.col("t"), F.col("e")).alias("v")).first().v
    assert put("a b c d", [1, 2]) == "a <i>b c</i> d" and put(" a  b ", [0]) == " <i>a</i>  b " and put("x", None) == "x"
    assert read(put("one two three", [0, 2])) == ("one two three", [0, 2])
    kept = lambda t, e: tuple(spark.createDataFrame([(t, e)], "t string, e array<int>").select(markup.normalized_markup(F.col("t"), F.col("e")).alias("v")).first().v)
    assert kept("a <i>b</i>", [0]) == ("a b", [1]) and kept("a <b>b</b>", [0]) == ("a b", [0]) and kept("a < b", [0]) == ("a < b", [0]) and kept("a", None) == ("a", None)
    end = lambda b, a: one(spark, markup.anchor_end(F.col("b"), F.col("a")), b=b, a=a)
    assert end("Some  Words here", "some words") == 11 and end("x", "y") is None and end("a 🙂 b. c", "🙂 b.") == 6 and end("x (a) y", "(a)") == 5 and end("x", " ") is None
    assert one(spark, markup.claims_in(F.col("a")), a="He met Anna in 1851. She left Paris, in 1,200 days. Anna stayed.") == ["Anna", "1851", "Paris", "1,200"]
    assert markup.correct_terms("teh cat. Teh teh-cat", [("teh", "the")]) == ("the cat. The teh-cat", 2)
    assert one(spark, markup.short_hash(F.col("a")), a="") == "ztntfp"


def test_a_left_out_run():
    assert readings.left_out("the cat sat on the mat today".split(), "the cat mat today".split()) == [(2, 3, 2)]


def test_hocr(spark):
    page = """<html><div class="ocr_page" title='bbox 0 0 9 9'><span title="x_wconf 91; bbox 1 2 3 4" class='ocrx_word'>A &amp;lt; <b>b</b></span>
    <span class='ocrx_word' title='bbox 1 2 x 4'>no box</span><span class='ocrx_word' title='bbox 5 6 7 8'>c</span></div><div class='ocr_page'></div></html>"""
    rows = hocr.parse(spark.createDataFrame([(1, page)], "file_id long, content string")).collect()
    assert [(r.page_index, r.word_no, r.text, r.confidence, r.x0, r.y1) for r in rows] == [(0, 0, "A &lt; b", 91.0, 1.0, 4.0), (0, 1, "c", 0.0, 5.0, 8.0)]


def test_html_walk():
    page = "<head><title>t</title></head>loose<p>one <em>two</em><p>three<script>'</p>'</script></p><h2>H</h2><ul><li>x<p>y</p></li></ul><blockquote><p>q</p></blockquote><table><tr><th>a<td>b<tr><td>c</table>"
    assert html.walk(page) == [("paragraph", 0, "loose"), ("paragraph", 0, "one <i>two</i>"), ("paragraph", 0, "three"), ("heading", 2, "H"), ("list-item", 0, "x"), ("paragraph", 0, "y"), ("blockquote", 0, "q"), ("table", 0, "a | b\nc")]
    assert html.walk(None) == []


def test_results_with_damaged_lines(spark):
    lines = ['{"custom_id":"page-00003","type":"succeeded","input":5}', '{"custom_id":"page-0000', '{"custom_id":"x","type":"errored","error":"bad"}', '{"custom_id":"page-9","type":"expired"}', "[]"]
    got = runs.parse_results(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert sorted((r.custom_id, r.page, r.ok, r.reason, r.input, r.output) for r in got) == [("page-00003", 3, True, None, 5, 0), ("page-9", 9, False, "the request expired", 0, 0), ("x", None, False, "bad", 0, 0)]


def test_halts_need_equal_messages(spark):
    log = [(1, k, m) for k, m in enumerate(["a", "a", None, "a", "b", "b", "b", "b"])] + [(2, 0, "a"), (2, 1, "a")]
    rows = spark.createDataFrame([(u, k, k, m) for u, k, m in log], "user_id long, ts long, event_id long, message string")
    assert [tuple(r) for r in runs.halts(rows).collect()] == [(1, 7)]


def test_streams(spark, tmp_path):
    from leafmill.streaming import watch

    log = [(1, f"2024-01-01 0{k}:00:00", k, m) for k, m in enumerate(["a", "a", None, "b", "b", "b", "b"])]
    rows = pd.DataFrame(log, columns=["user_id", "ts", "event_id", "message"])
    source, schema = str(tmp_path / "in"), "user_id long, ts timestamp, event_id long, message string"
    for k in range(0, len(rows), 3):
        part = spark.createDataFrame(rows[k : k + 3].astype(object).where(rows[k : k + 3].notna(), None).values.tolist(), "user_id long, ts string, event_id long, message string")
        part.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = watch.halt_stream(stream).writeStream.format("memory").queryName("halted").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert [tuple(r) for r in spark.table("halted").collect()] == [(1, 6, "b")]

    lines, table, place = str(tmp_path / "lines"), str(tmp_path / "table"), str(tmp_path / "c2")
    for n in (1, 2):
        spark.createDataFrame([(f'{{"custom_id":"page-{n}","type":"succeeded"}}',)], "value string").coalesce(1).write.mode("append").text(lines)
        follow = spark.readStream.text(lines).withColumnRenamed("value", "line")
        watch.collect_results(follow, table, place).awaitTermination(120)
    assert sorted(r.page for r in spark.read.parquet(table).collect()) == [1, 2]


def test_readings_numbered_apart_are_aligned_over_their_whole_length(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(3000)}" for _ in range(9000)]
    tok = lambda key, ws: [(key, k + 1, w) for k, w in enumerate(ws)]
    kinds = "doc_id long, pos long, token string"
    first = spark.createDataFrame(tok(1, words) + tok(2, ["a", "b", "c"]) + tok(3, ["same"] * 50) + tok(4, words[:40]), kinds)
    second = spark.createDataFrame(tok(1, words[300:5000] + words[5006:]) + tok(2, ["A,", "b", "c"]) + tok(3, ["same"] * 44) + tok(4, ["x"]), kinds)
    got = {}
    for r in readings.compare_readings(first, second).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n, r.strength))
    assert sorted(got[1]) == [(1, 300, "strong"), (5001, 6, "strong")]
    assert 2 not in got and sum(n for _, n, _ in got[3]) == 6 and got[4] == [(1, 40, "strong")]


def test_tickets_expire_and_are_given_up_across_restarts(spark, tmp_path):
    """Tries that come in three parts, each a run of its own: what a key's state and timers held goes on."""
    from leafmill.streaming import watch

    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kinds = "key long, id long, ts timestamp, failed boolean"
    at = lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    parts = [
        [(1, 1, at(0), True), (2, 2, at(0), True), (3, 3, at(1), False)], [(1, 4, at(5), True), (3, 5, at(6), True), (4, 6, at(7), True)],
        [(1, 7, at(9), True), (1, 8, at(10), True), (4, 9, at(40), True), (3, 10, at(20), False)], [(9, 11, at(2000), False)],
    ]
    source, out, place = (str(tmp_path / n) for n in ("tries", "out", "place"))
    try:
        for part in parts:
            spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(source)
            stream = watch.ticket_stream(spark.readStream.schema(kinds).parquet(source))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    got = sorted((r.key, r.id, r.outcome, (pd.Timestamp(r["at"]) - at(0)).total_seconds() / 3600) for r in spark.read.parquet(out).collect())
    assert got == [
        (1, 1, "retried", 0), (1, 4, "retried", 5), (1, 7, "given up", 9), (1, 8, "expired", 34), (1, 8, "retried", 10), (2, 2, "expired", 24), (2, 2, "retried", 0),
        (3, 5, "retried", 6), (4, 6, "expired", 31), (4, 6, "retried", 7), (4, 9, "expired", 64), (4, 9, "retried", 40),
    ]


def test_ages_count_parts_of_seconds(spark):
    from leafmill.functions.text import age

    rows = spark.createDataFrame([("2029-12-31 23:59:00.5",), ("2029-12-31 23:59:00",), ("2029-12-31 22:59:59.999999",)], "ts string")
    now = F.lit("2030-01-01 00:00:00").cast("timestamp_ntz")
    assert [r.a for r in rows.select(age(F.col("ts").cast("timestamp_ntz"), now).alias("a")).collect()] == ["just now", "1 minute ago", "1 hour ago"]
