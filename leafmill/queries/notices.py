"""Checks of names and numbers, messages, folios and running heads, stored facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notices as N
from ..functions import text as T
from ..operators import additions, annotations
from ..plans.views import blocks, sql, table
from ..sources import hocr

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


@query("m25_repository_names", r"""
select page_id, regexp_full_match(trim(name), '[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+') valid from (select page_id, regexp_replace(url, '^[a-z]+://', '') || case when page_id % 3 = 0 then '' when page_id % 3 = 1 then ' ' else '/x' end as name from pages)""")
def m25(spark, sf):
    k = F.col("page_id") % 3
    name = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.when(k == 0, "").when(k == 1, " ").otherwise("/x"))
    return table(spark, sf, "pages").select("page_id", N.valid_repository(name).alias("valid"))


@query("m30_session_names", """
select doc_id, regexp_full_match(name, '[a-z0-9][a-z0-9-]{0,62}') valid from (select doc_id, source || case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then '-' || doc_id when doc_id % 4 = 2 then upper(lang) else '/' || repeat('a', doc_id % 90) end as name from documents)""")
def m30(spark, sf):
    k = F.col("doc_id") % 4
    more = F.when(k == 0, "").when(k == 1, F.concat(F.lit("-"), F.col("doc_id").cast("string"))).when(k == 2, F.upper("lang")).otherwise(F.concat(F.lit("/"), F.repeat(F.lit("a"), (F.col("doc_id") % 90).cast("int"))))
    return table(spark, sf, "documents").select("doc_id", N.valid_session(F.concat("source", more)).alias("valid"))


@query("m28_scan_refusals", """
select doc_id, case when n_chars * 9000 > 41943040 then 'The scan is ' || floor(n_chars * 9000 / 1048576::double + 0.5)::bigint || ' MB, past the 40 MB this app will send — GitHub refuses a file over 100 MB and the upload is a third larger again. Everything else about the book was saved; opening it on another device will ask for the scan.' end refusal from documents""")
def m28(spark, sf):
    return table(spark, sf, "documents").select("doc_id", N.scan_refusal(F.col("n_chars") * 9000).alias("refusal"))


@query("m22_ticket_lines", """
with t as (select user_id, count(*) pages, count(*) filter (where event_id % 5 <> 0 or user_id % 2 = 0) submitted, count(distinct event_type) batches from events group by user_id)
select user_id, case when submitted >= pages then 'all ' || pages else submitted || ' of ' || pages end || ' page(s) submitted 2 hours ago to m' || user_id % 3 || ', in ' || batches || ' batch' || case when batches = 1 then '' else 'es' end || '.' line from t""")
def m22(spark, sf):
    kept = (F.col("event_id") % 5 != 0) | (F.col("user_id") % 2 == 0)
    t = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("pages"), F.count_if(kept).alias("submitted"), F.count_distinct("event_type").alias("batches"))
    model = F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))
    return t.select("user_id", N.ticket_line(F.col("pages"), F.col("submitted"), F.col("batches"), F.lit("2 hours ago"), model).alias("line"))


@query("a17_second_looks", """
with s as (select user_id, count(*) spots, count(*) filter (where event_id % 5 = 0) a, count(*) filter (where event_id % 5 = 1) b, count(*) filter (where event_id % 5 = 2 and user_id % 2 = 0) c,
  count(*) filter (where event_id % 5 = 3 and user_id % 3 = 0) d, count(*) filter (where event_type = 'error' and user_id % 4 = 0) f from events group by user_id)
select user_id, concat_ws(' · ', spots || ' spot(s) looked at again', a || ' were not on the page', b || ' really were dropped', case when c > 0 then c || ' read differently from both' end,
  case when d > 0 then d || ' could not be settled' end, case when f > 0 then f || ' leaf/leaves could not be checked' end) || '.' said from s""")
def a17(spark, sf):
    turn, user = F.col("event_id") % 5, F.col("user_id")
    n = lambda c, name: F.count_if(c).alias(name)
    s = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("spots"), n(turn == 0, "a"), n(turn == 1, "b"), n((turn == 2) & (user % 2 == 0), "c"), n((turn == 3) & (user % 3 == 0), "d"), n((F.col("event_type") == "error") & (user % 4 == 0), "f")
    )
    return s.select("user_id", N.second_look(*(F.col(c) for c in ("spots", "a", "b", "c", "d", "f"))).alias("said"))


_TERMS = "t as (select doc_id, list_filter(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{6,}'))), lambda x: doc_id % 5 <> 0) l from documents)"


def _terms(spark, sf):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0))))
    return table(spark, sf, "documents").select("doc_id", F.filter(found, lambda x: F.col("doc_id") % 5 != 0).alias("terms"))


@query("m39_vocabulary_requests", f"""
with {_TERMS} select doc_id, case when len(l) = 0 then '' else 'KNOWN VOCABULARY IN THIS WORK.' || chr(10) || 'These spellings have been confirmed as correct for this book. Prefer them' || chr(10)
  || 'over similar modern words when the pixels are ambiguous, and reproduce them' || chr(10) || 'exactly:' || chr(10) || array_to_string(l, ', ') end said from t""")
def m39(spark, sf):
    return _terms(spark, sf).select("doc_id", N.vocabulary_request(F.col("terms")).alias("said"))


@query("m40_vocabulary_reminders", f"""
with {_TERMS} select doc_id, case when len(l) = 0 then '' else 'Known vocabulary in this work — these spellings are CORRECT and must be' || chr(10)
  || 'preserved exactly. Do not modernize or substitute a similar modern word:' || chr(10) || array_to_string(l, ', ') end said from t""")
def m40(spark, sf):
    return _terms(spark, sf).select("doc_id", N.vocabulary_reminder(F.col("terms")).alias("said"))


@query("p65_response_failures", """
with r as (select event_id, [200, 404, 429, 500, 503, 204, 401][event_id % 7 + 1] status from events)
select event_id, status, 'API error ' || status || case when event_id % 3 = 0 then ': no ' || event_id % 10 else '' end message, status = 429 or status >= 500 retryable from r where status not between 200 and 299""")
def p65(spark, sf):
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, [200, 404, 429, 500, 503, 204, 401])), (k % 7 + 1).cast("int"))
    body = F.when(k % 3 == 0, F.concat(F.lit('{"error":{"message":"no '), (k % 10).cast("string"), F.lit('"}}'))).when(k % 3 == 1, '{"error":null}').otherwise("<html>not JSON")
    rows = table(spark, sf, "events").select("event_id", status.alias("status"), N.response_failure(status, body).alias("f"))
    return rows.where("f is not null").select("event_id", "status", "f.*")


@query("m35_batch_states", """
select event_id, case when event_id % 6 <> 0 then 'b' || event_id end id, case when event_id % 6 <> 0 then case event_type when 'error' then 'ended' when 'click' then 'canceling' else 'in_progress' end end state,
  case when event_id % 6 <> 0 then event_id % 13 end::bigint processing, case when event_id % 6 <> 0 then case when event_id % 4 = 0 then 0 else event_id % 17 end end::bigint succeeded, case when event_id % 6 <> 0 then 0 end::bigint errored from events""")
def m35(spark, sf):
    k = F.col("event_id")
    state = F.when(F.col("event_type") == "error", "ended").when(F.col("event_type") == "click", "canceling").otherwise("paused")
    fields = [F.when(k % 6 != 0, F.concat(F.lit("b"), k.cast("string"))).alias("id"), state.alias("processing_status")]
    counts = F.struct((k % 13).alias("processing"), F.when(k % 4 == 0, "many").otherwise((k % 17).cast("string")).alias("succeeded"))
    raw = F.to_json(F.struct(*fields, counts.alias("request_counts")))
    return table(spark, sf, "events").select("event_id", N.batch_status(raw).alias("s")).select("event_id", "s.id", "s.state", "s.processing", "s.succeeded", "s.errored")


@query("m53_picked_numbers", """
select doc_id, case doc_id % 6 when 0 then doc_id / 4::double when 1 then 12.5 when 2 then 0 when 3 then 7 when 4 then 7 else -300 end::double n from documents""")
def m53(spark, sf):
    k = F.col("doc_id")
    answer = F.when(k % 6 == 0, (k / 4).cast("string")).when(k % 6 == 1, " 12.5 ").when(k % 6 == 2, "").when(k % 6 == 3, F.concat(k.cast("string"), F.lit(" pt"))).when(k % 6 == 5, "-3e2")
    return table(spark, sf, "documents").select("doc_id", N.pick_number(answer, F.lit(7.0)).alias("n"))


_PAGES = "g as (select doc_id, doc_id % 50 i, doc_id % 50 < 6 front, len(string_split(text, chr(10))) - 1 n_lines, doc_id % 11 = 0 hidden, source, lang from documents)"
_FOLIO = "case when hidden or n_lines = 0 then null when front then ['i', 'ii', 'iii', 'iv', 'v', 'vi'][i + 1] else (i - 6 + 1)::varchar end"


def _folios(spark, sf):
    i = F.col("doc_id") % 50
    d = table(spark, sf, "documents").select("doc_id", i.alias("i"), (F.size(F.split("text", "\n")) - 1).alias("n_lines"), "source", "lang")
    return d.withColumn("folio", N.folio(F.col("i"), F.lit(6), F.col("i") < 6, F.col("n_lines"), F.col("doc_id") % 11 == 0))


@query("p54_folios", f"with {_PAGES} select doc_id, {_FOLIO} folio from g")
def p54(spark, sf):
    return _folios(spark, sf).select("doc_id", "folio")


@query("m09_running_heads", f"""
with {_PAGES} select doc_id, case doc_id % 5 when 0 then source when 1 then lang when 2 then case when doc_id % 3 = 0 then source else 'part ' || doc_id % 3 end when 3 then coalesce({_FOLIO}, '') else '' end head from g""")
def m09(spark, sf):
    k = F.col("doc_id")
    mode = F.element_at(F.array(*map(F.lit, ["bookTitle", "author", "chapterTitle", "pageNumber", "none"])), (k % 5 + 1).cast("int"))
    chapter = F.when(k % 3 != 0, F.concat(F.lit("part "), (k % 3).cast("string")))
    return _folios(spark, sf).select("doc_id", N.running_head(mode, F.col("source"), F.col("lang"), chapter, F.col("folio")).alias("head"))


@query("m07_baselines", r"""
with i as (select p_partkey, ['6x9', '5.5 x 8.5', '8X10', 'a4'][p_partkey % 4 + 1] t, (p_partkey % 9) * 0.125::double m, 9 + p_partkey % 5 size from part),
d as (select *, case when t = 'a4' then 9.0 else regexp_extract(t, '([0-9.]+)\s*$', 1)::double end * 72 h from i)
select p_partkey, round(greatest(12, m * 72 - size * 1.2::double), 6) head, round(h - m * 72 + size * 1.6::double, 6) foot from d""")
def m07(spark, sf):
    k = F.col("p_partkey")
    trim = F.element_at(F.array(*map(F.lit, ["6x9", "5.5 x 8.5", "8X10", "a4"])), (k % 4 + 1).cast("int"))
    margin, size = (k % 9) * 0.125, k % 5 + 9
    return table(spark, sf, "part").select("p_partkey", F.round(N.head_baseline(margin, size), 6).alias("head"), F.round(N.foot_baseline(trim, margin, size), 6).alias("foot"))


_SLUG = r"rtrim(ltrim(regexp_replace(lower(trim({0})), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-'), '-')[1:48]"


@query("p34_bank_stems", f"""
select c_custkey, case when s = '' then 'fact-bank' else s end stem from (select c_custkey, array_to_string(list_filter([{_SLUG.format('a')}, {_SLUG.format('t')}, regexp_replace(y, '[^0-9]', '', 'g')[1:4]], lambda x: x <> ''), '--') s
from (select c_custkey, case when c_custkey % 7 = 0 then ' . ' else c_name end a, case when c_custkey % 7 = 0 then '' when c_custkey % 3 = 0 then '' else c_mktsegment end t,
  case when c_custkey % 4 = 1 then 'c. ' || (1700 + c_custkey % 250) || '-05' when c_custkey % 4 = 2 then 'n.d.' else '' end y from customer))""")
def p34(spark, sf):
    k = F.col("c_custkey")
    author, title = F.when(k % 7 == 0, " . ").otherwise(F.col("c_name")), F.when((k % 7 == 0) | (k % 3 == 0), "").otherwise(F.col("c_mktsegment"))
    year = F.when(k % 4 == 1, F.concat(F.lit("c. "), (1700 + k % 250).cast("string"), F.lit("-05"))).when(k % 4 == 2, "n.d.").otherwise("")
    return table(spark, sf, "customer").select("c_custkey", N.bank_stem(author, title, year).alias("stem"))


@query("p32_body_keys", sql("blocks", """
, s as (select doc_id, count(*) n, string_agg('p' || doc_id || 'b' || bi || ':' || length(text), '|' order by bi) seed from blocks group by doc_id),
h as (select *, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(seed, ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) h from s)
select doc_id, n || '-' || ltrim(list_reduce(list_transform(range(6, -1, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // (36 ** k)::bigint) % 36 + 1)::int, 1)), lambda a, c: a || c), '0') "key" from h"""))
def p32(spark, sf):
    b = blocks(table(spark, sf, "documents"))
    one = F.struct("bi", F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit("b"), F.col("bi").cast("string")).alias("id"), "text")
    return b.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("b")).select("doc_id", N.body_key(F.col("b")).alias("key"))


@query("w39_last_words", sql("blocks", r"""
select doc_id, bi, greatest(0, len(list_filter(string_split_regex(text[1:(doc_id * 7 + bi * 3) % 60], '\s+'), lambda w: w <> '')) - 1)::int word from blocks"""))
def w39(spark, sf):
    cut = F.substring("text", F.lit(1), ((F.col("doc_id") * 7 + F.col("bi") * 3) % 60).cast("int"))
    return blocks(table(spark, sf, "documents")).select("doc_id", "bi", N.last_word_index(cut).cast("int").alias("word"))


@query("m13_line_widths", """
with w as (select l_orderkey, list(l_quantity::double order by l_linenumber, l_quantity) l from lineitem where l_returnflag = 'R' group by 1)
select o_orderkey, coalesce(case when len(l) > 0 then l[least(o_orderkey % 9, len(l) - 1) + 1] end, 0) width from orders left join w on l_orderkey = o_orderkey""")
def m13(spark, sf):
    w = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))).alias("w"))
    widths = F.coalesce(F.transform("w", lambda x: x["q"]), F.array().cast("array<double>"))
    return table(spark, sf, "orders").join(w, "o_orderkey", "left").select("o_orderkey", N.width_for_line(widths, (F.col("o_orderkey") % 9).cast("int")).alias("width"))


@query("m45_progress", "select user_id, count(distinct event_type) done, 7 total, floor(count(distinct event_type) / 7 * 100 + 0.5)::bigint pct from events group by user_id")
def m45(spark, sf):
    done = table(spark, sf, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n"))
    return done.select("user_id", N.progress(F.col("n"), 7).alias("p")).select("user_id", "p.*")


@query("m54_saved_looks", """
select p_partkey, concat_ws(' · ', ['6x9', '5.5x8.5'][p_partkey % 2 + 1] || 'in', p_type || ' at ' || (9 + p_partkey % 5) || 'pt', case when p_partkey % 3 <> 0 then p_brand end) said from part""")
def m54(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", N.saved_look(F.when(k % 2 == 0, "6x9").otherwise("5.5x8.5"), F.col("p_type"), k % 5 + 9, F.when(k % 3 != 0, F.col("p_brand")).otherwise("")).alias("said"))


@query("m01_cleaned_tables", """
select l_orderkey, string_agg(l_linenumber || ' | ' || l_linestatus || l_shipdate || ' | ' || l_returnflag, chr(10) order by l_linenumber, l_linestatus, l_shipdate, l_returnflag) as text from lineitem group by 1""")
def m01(spark, sf):
    soft = F.concat("l_linestatus", F.lit("­"), F.col("l_shipdate").cast("string"))
    row = F.struct("l_linenumber", "l_linestatus", F.array(F.col("l_linenumber").cast("string"), soft, F.concat("l_returnflag", F.lit("­"))).alias("cells"))
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("cells"))
    return t.select("l_orderkey", T.table_text(F.transform("cells", lambda r: F.transform(r, T.strip_soft_hyphens))).alias("text"))


@query("w38_stored_facts", """
with e as (select conv_id, turn, case when turn % 4 = 1 then '' else trim(text[1:20]) end title, trim(text[21:60]) body, role from conversations),
g as (select *, title <> '' and body <> '' good from e)
select conv_id, count(*) filter (where good) n, count(*) filter (where not good)::int discarded,
  string_agg(title || '/' || body || '/' || case when turn % 3 = 0 then 'stated' else 'context' end || '/' || case when turn % 2 = 0 then role || ' of old' else 'general' end, '~' order by turn) filter (where good) facts from g group by conv_id""")
def w38(spark, sf):
    turn = F.col("turn")
    fact = F.struct(
        F.when(turn % 4 != 1, F.substring("text", 1, 20)).alias("title"), F.substring("text", 21, 40).alias("body"), F.when(turn % 3 == 0, "stated").when(turn % 3 == 1, "certain").alias("footing"),
        F.when(turn % 2 == 0, F.concat(F.lit(" "), F.upper("role"), F.lit("_of_old "))).alias("category"),
    )
    sent = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", fact.alias("f")))), lambda x: x["f"]).alias("facts"))
    read = sent.select("conv_id", N.facts_in(F.to_json(F.struct("facts"))).alias("r"))
    said = F.array_join(F.transform("r.facts", lambda f: F.concat_ws("/", f["title"], f["body"], f["footing"], f["category"])), "~")
    return read.select("conv_id", F.size("r.facts").cast("long").alias("n"), "r.discarded", F.when(F.size("r.facts") > 0, said).alias("facts"))


@query("s02_decode_entities", "select doc_id, sha256(coalesce(text, '') || ' &#fa; &bogus; &#1114112; &#xD800;A') text_sha256 from documents")
def s02(spark, sf):
    """Every document with its marks and letters beyond ASCII written as entities of all kinds, and read again."""
    def entity(c):
        code = F.ascii(c)
        numbered = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("&#"), code.cast("string"), F.lit(";"))).otherwise(F.concat(F.lit("&#x"), F.lower(F.hex(code)), F.lit(";")))
        return F.when(c == "&", "&amp;").when(c == "<", "&lt;").when(c == '"', "&quot;").when(c == "'", "&apos;").when(code > 127, numbered).otherwise(c)

    text = F.coalesce("text", F.lit(""))
    written = F.concat(F.array_join(F.transform(F.split(text, ""), entity), ""), F.lit(" &#fa; &bogus; &#1114112; &#xD800;&#65;"))
    return table(spark, sf, "documents").select("doc_id", written.alias("t")).select("doc_id", F.sha2(hocr.decoded(F.col("t")), 256).alias("text_sha256"))


@query("m26_about_books", """
select page_id, case when page_id % 5 <> 0 then 'k' || page_id end "key", case when page_id % 5 = 0 then null when page_id % 3 = 0 then url else 'a book' end file_name, case when page_id % 5 = 0 then null when page_id % 2 = 0 then page_id else 0 end pages,
  case when page_id % 5 <> 0 then page_id % 7 <> 0 end complete from pages""")
def m26(spark, sf):
    k = F.col("page_id")
    raw = F.to_json(F.struct(
        F.when(k % 5 != 0, F.concat(F.lit("k"), k.cast("string"))).alias("key"), F.when(k % 3 == 0, F.col("url")).alias("fileName"),
        F.when(k % 2 == 0, k).alias("pageCount"), F.when(k % 7 == 0, F.lit(False)).alias("complete"),
    ))
    return table(spark, sf, "pages").select("page_id", N.about_book(F.when(k % 10 == 5, "not JSON").otherwise(raw)).alias("a")).select("page_id", "a.*")


_CLAIMS = r"""
, mine as (select doc_id, bi, text, 'd' || doc_id || 'b' || bi block_id from blocks),
n as (select b.doc_id, b.bi, b.text block, o.text note from mine b join mine o on o.doc_id = b.doc_id + 1 and o.bi = b.bi),
s as (select doc_id, bi, unnest(string_split(regexp_replace(note, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) sentence from n),
w as (select doc_id, bi, unnest(l) w, unnest(range(0, len(l))) k from (select doc_id, bi, regexp_extract_all(sentence, '\d[\d,.]*\d|\d|\p{L}[\p{L}\p{N}_''’-]*') l from s)),
c as (select distinct doc_id, bi, w claim from w where regexp_matches(w, '^\d') or (k > 0 and regexp_matches(w, '^\p{Lu}') and length(w) >= 2)),
o as (select c.doc_id, c.bi, count(*) outside from c join documents d on d.doc_id = c.doc_id where not contains(lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))), lower(claim)) group by all),
checked as (select n.doc_id, n.bi, n.note, case when n.bi % 5 > 0 then nullif(length(regexp_extract(block, '^\s*(\S+\s+){0,2}\S+')), 0) end::int "at", coalesce(outside, 0)::int n_outside from n left join o on o.doc_id = n.doc_id and o.bi = n.bi)
"""


def _checked(spark, sf):
    """Of each block the same block of the next document as a note on it, anchored at its first words, or at none."""
    docs = table(spark, sf, "documents")
    b = blocks(docs).withColumn("block_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("b"), F.col("bi").cast("string")))
    first = F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, 3), " ")
    anchors = b.select("doc_id", "bi", "block_id", F.when(F.col("bi") % 5 == 0, "zz qq").otherwise(first).alias("anchor"))
    notes = b.select((F.col("doc_id") - 1).alias("doc_id"), "bi", "text")
    proposals = anchors.join(notes, ["doc_id", "bi"]).withColumn("book", F.col("doc_id"))
    return annotations.check_proposals(proposals, b, docs.select(F.col("doc_id").alias("book"), "text"))


@query("j03_checked_proposals", sql("blocks", _CLAIMS + 'select doc_id, bi, "at", n_outside from checked'))
def j03(spark, sf):
    return _checked(spark, sf).select("doc_id", "bi", "at", F.size("outside").alias("n_outside"))


@query("w32_note_edits", sql("blocks", _CLAIMS + """
select 'd' || doc_id || 'b' || bi block_id, "at", trim(note) as text, "at" is null unplaced from checked where bi % 4 > 0 and trim(note) <> ''"""))
def w32(spark, sf):
    given = _checked(spark, sf).withColumn("text", F.when(F.col("bi") % 4 == 0, F.lit("  ")).otherwise(F.col("text")))
    return annotations.note_edits(given)


@query("p51_facts_of_notes", sql("blocks", r"""
, n as (select doc_id, bi, text, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) words from blocks)
select text[1:15] title, text body, 'context' footing, case bi % 3 when 0 then 'general' when 1 then 'term of art' else 'person' end category, case when bi % 7 = 0 then 'gone' else 'd' || doc_id || 'b' || bi end block_id,
  case when bi % 7 <> 0 then doc_id % 50 end source_page, bi % 7 <> 0 quote_verified from n where words >= 12"""))
def p51(spark, sf):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("b"), F.col("bi").cast("string"))
    b, turn = blocks(table(spark, sf, "documents")), F.col("bi") % 3
    kind = F.when(turn == 0, " ").when(turn == 1, " Term_of_Art").otherwise("person")
    notes = b.select(F.when(F.col("bi") % 7 == 0, "gone").otherwise(name).alias("block_id"), F.substring("text", 1, 15).alias("anchor"), "text", kind.alias("kind"))
    return annotations.facts_of_notes(notes, b.select(name.alias("block_id"), (F.col("doc_id") % 50).alias("source_page")))


#: An edit of each kind for every block: targets repeat within a document, so that later edits replace earlier ones.
_ADDED = """
, there as (select doc_id, 'b' || bi block_id from blocks where bi % 5 <> 4),
e as (select doc_id, bi, text, bi % 3 turn, case when bi % 7 = 3 then null else 'b' || bi end at_block, bi % 50 x, bi % 20 y, bi % 4 q4 from blocks),
l as (select * from (select *, row_number() over (partition by doc_id, turn order by bi desc) r from e) where r = 1)
"""
_SIZE = """case when q4 % 2 = 1 then {h} else {w} end::int width, case when q4 % 2 = 1 then {w} else {h} end::int height""".format(w="least(120, 400 - x)", h="300 - y")


def _edit_log(spark, sf):
    """(edits, the blocks that are left, all blocks)"""
    b = blocks(table(spark, sf, "documents")).withColumn("block_id", F.concat(F.lit("b"), F.col("bi").cast("string")))
    bi = F.col("bi").cast("int")
    whole = "struct<op:string,x:int,y:int,width:int,height:int,degrees:int>"
    op = lambda name, x, y, width, degrees: F.struct(F.lit(name).alias("op"), x.alias("x"), y.alias("y"), width.alias("width"), F.lit(None).cast("int").alias("height"), degrees.alias("degrees")).cast(whole)
    nil = F.lit(None).cast("int")
    ops = F.array(op("crop", bi % 50, bi % 20, F.lit(120), nil), op("rotate", nil, nil, nil, bi % 4 * 90), op("levels", nil, nil, nil, nil))
    place = F.when(F.col("bi") % 7 != 3, F.col("block_id"))
    kinds = F.explode(F.array(*map(F.lit, ("note", "image", "anchor", "retouch", "section"))))
    log = b.select(
        "doc_id", kinds.alias("kind"), F.col("bi").alias("seq"), F.concat(F.lit("t"), (F.col("bi") % 3).cast("string")).alias("target"), place.alias("block_id"), (F.col("bi") % 9).alias("at"),
        F.concat(F.lit("  "), F.col("text"), F.lit("\n \n"), F.col("text")).alias("value"), F.when(F.col("bi") % 2 == 0, " ").otherwise(F.col("kind")).alias("title"), F.lit(400).alias("width"), F.lit(300).alias("height"), ops.alias("ops"),
    )
    return log, b.where("bi % 5 <> 4").select("doc_id", "block_id"), b


@query("w13_added_notes", sql("blocks", _ADDED + """
select doc_id, 't' || turn note_id, at_block block_id, bi % 9 "at", length(text) * 2 + 3 n from l semi join there t on t.doc_id = l.doc_id and t.block_id = l.at_block"""))
def w13_notes(spark, sf):
    log, left, _ = _edit_log(spark, sf)
    return additions.notes(log, left).select("doc_id", "note_id", "block_id", "at", F.length("text").alias("n"))


@query("w13_supplied_pictures", sql("blocks", _ADDED + f"""
select l.doc_id, 't' || turn picture_id, at_block block_id, {_SIZE} from l left join there t on t.doc_id = l.doc_id and t.block_id = l.at_block where at_block is null or t.block_id is not null"""))
def w13_supplied(spark, sf):
    log, left, _ = _edit_log(spark, sf)
    return additions.supplied_pictures(log, left)


@query("w13_anchored_pictures", sql("blocks", _ADDED + f"""
, o as (select doc_id, bi from blocks where bi < 5)
select o.doc_id, 't' || o.bi picture_id, case when l.turn is not null and (l.at_block is null or t.block_id is not null) then l.at_block else 'b' || o.bi end block_id,
  case when l.turn is null then 400 when q4 % 2 = 1 then 300 - y else least(120, 400 - x) end::int width, case when l.turn is null then 300 when q4 % 2 = 1 then least(120, 400 - x) else 300 - y end::int height
from o left join l on l.doc_id = o.doc_id and l.turn = o.bi left join there t on t.doc_id = l.doc_id and t.block_id = l.at_block"""))
def w13_anchored(spark, sf):
    log, left, b = _edit_log(spark, sf)
    own = b.where("bi < 5").select("doc_id", F.concat(F.lit("t"), F.col("bi").cast("string")).alias("picture_id"), "block_id", F.lit(400).alias("width"), F.lit(300).alias("height"))
    return additions.own_pictures(own, log, left)


@query("w13_added_sections", sql("blocks", _ADDED + """
, k as (select l.*, b.kind from l join blocks b using (doc_id, bi))
select doc_id, 't' || turn section_id, case when bi % 2 = 0 then 'Introduction' else kind end title, n, text from k, (values (0), (1)) v(n)"""))
def w13_sections(spark, sf):
    return additions.sections(_edit_log(spark, sf)[0])
