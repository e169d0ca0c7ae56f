"""Assembly, checks across pages, chunks, facts, logs and stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as T
from ..operators import assemble, facts, pages, runs
from ..plans.views import blocks, book_of, sql, table, tokens
from ..plans.views import pages as page_view

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def _blocks(spark, sf):
    return blocks(table(spark, sf, "documents"))


_JOINS = r"""
, pairs as (select *, lag(kind) over w pk, lag(text) over w pt from {} window w as (partition by doc_id order by bi))
, seams as (select doc_id, bi, kind, text, pt, coalesce(pk = kind and kind in ('paragraph', 'verse') and
   (not regexp_matches(rtrim(pt), '[.!?:;"'')\]]$') or regexp_matches(rtrim(pt), '-$')) and regexp_matches(ltrim(text), '^\p{{Ll}}'), false) joins from pairs)
"""


@query("w01_should_join", sql("blocks", _JOINS.format("blocks") + "select doc_id, bi, joins from seams"))
def w01(spark, sf):
    return assemble.seams(_blocks(spark, sf)).select("doc_id", "bi", "joins")


@query("t06_join_text", sql("blocks", r"""
, p as (select doc_id, bi, rtrim(lag(text) over (partition by doc_id order by bi)) a, ltrim(text) b from blocks)
select doc_id, bi, case when regexp_matches(a, '\p{L}[-\x{AD}]$') then regexp_replace(a, '[-\x{AD}]$', '') || b else concat_ws(' ', a, b) end joined from p where a is not null"""))  # fmt: skip
def t06(spark, sf):
    from pyspark.sql import Window

    both = _blocks(spark, sf).withColumn("a", F.lag("text").over(Window.partitionBy("doc_id").orderBy("bi")))
    return both.where("a is not null").select("doc_id", "bi", T.join_text(F.col("a"), F.col("text")).alias("joined"))


@query("w02_assemble", sql("blocks", ", flow as (select * from blocks where kind not in ('footnote', 'caption'))" + _JOINS.format("flow") + """
, isl as (select *, sum((not joins)::int) over (partition by doc_id order by bi) g from seams)
select doc_id, min(bi) bi, arg_min(kind, bi) kind, count(*) n, string_agg(case when joins then ltrim(text) else text end, ' ' order by bi) as text from isl group by doc_id, g"""))  # fmt: skip
def w02(spark, sf):
    return assemble.assemble(_blocks(spark, sf))


@query("w05_flow_ends", sql("blocks", """
select doc_id, arg_min(text, bi) "first", arg_min(kind, bi) first_kind, arg_max(text, bi) "last" from blocks where kind not in ('footnote', 'caption', 'table') group by doc_id"""))
def w05(spark, sf):
    return assemble.flow_ends(_blocks(spark, sf))


@query("w04_seam_findings", sql("blocks pages_", r"""
, ends as (select doc_id, arg_min(text, bi) f, arg_min(kind, bi) fk, arg_max(text, bi) l from blocks where kind not in ('footnote', 'caption', 'table') group by doc_id)
, body as (select book, page_index, trim(regexp_replace(l, '\s+', ' ', 'g')) tail, f, fk from pages_ join ends using (doc_id) where role not in ('blank', 'plate'))
, pairs as (select book, lead(page_index) over w page_index, tail, trim(regexp_replace(lead(f) over w, '\s+', ' ', 'g')) head, lead(fk) over w hk from body window w as (partition by book order by page_index))
select book, page_index, right(tail, 40) "before", head[1:40] "after" from pairs where tail <> '' and head <> '' and hk <> 'heading'
  and not regexp_matches(tail, '[.!?…:;”’")\]]$') and regexp_matches(head, '^["“‘''(\p{Lu}]')"""))  # fmt: skip
def w04_seams(spark, sf):
    docs = table(spark, sf, "documents")
    return assemble.seam_findings(page_view(docs), assemble.flow_ends(blocks(docs)))


@query("w04_duplicate_pages", sql("pages_", r"""
, n as (select book, page_index, trim(regexp_replace(text, '\s+', ' ', 'g')) t from pages_)
, f as (select *, min(page_index) over (partition by book, t) first_page from n where length(t) >= 200)
select book, page_index, first_page from f where page_index > first_page"""))  # fmt: skip
def w04_duplicates(spark, sf):
    return assemble.duplicate_findings(page_view(table(spark, sf, "documents")))


@query("w04_missing_furniture", sql("pages_", """
, b as (select book, page_index, case when doc_id % 13 <> 0 then upper(source) end h, case when doc_id % 17 <> 0 then page_index + 1 end f from pages_ where role not in ('blank', 'plate'))
, c as (select *, count(*) over (partition by book) n, count(h) over (partition by book) nh, count(f) over (partition by book) nf from b)
select book, page_index, 'running_head' missing from c where n >= 5 and nh / n >= .6 and h is null
union all select book, page_index, 'folio' from c where n >= 5 and nf / n >= .6 and f is null"""))  # fmt: skip
def w04_furniture(spark, sf):
    return assemble.furniture_findings(pages.furniture(page_view(table(spark, sf, "documents"))))


_CHUNKS = r"""
, sized as (select doc_id, bi, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) words from blocks)
, walk(doc_id, bi, words, chunk, filled) as (
  select doc_id, bi, words, 0::bigint, words from sized where bi = 0
  union all select s.doc_id, s.bi, s.words, case when filled > 0 and filled + s.words > 1200 then chunk + 1 else chunk end,
    case when filled > 0 and filled + s.words > 1200 then s.words else filled + s.words end
  from walk w join sized s on s.doc_id = w.doc_id and s.bi = w.bi + 1)
"""


@query("w07_chunk_blocks", sql("blocks", _CHUNKS + "select doc_id, bi, words, chunk from walk", recursive=True))
def w07(spark, sf):
    return assemble.chunks(_blocks(spark, sf))


@query("w07_prose_chunks", sql("blocks", _CHUNKS.replace("1200", "30") + """
, k as (select w.*, kind from walk w join blocks using (doc_id, bi)), p as (select doc_id, chunk, row_number() over (partition by doc_id order by chunk) - 1 m from k group by 1, 2 having bool_or(kind not in ('heading', 'caption', 'footnote', 'table')))
select doc_id, bi, kind, m::bigint as chunk from k join p using (doc_id, chunk)""", recursive=True))
def w07_prose(spark, sf):
    """Small chunks, without those of headings, captions, notes and tables only."""
    b = _blocks(spark, sf)
    cut = assemble.chunks(b, 30).join(b.select("doc_id", "bi", "kind"), ["doc_id", "bi"])
    return assemble.prose_chunks(cut.select("doc_id", "bi", "kind", "chunk"))


@query("w08_context_for", sql("blocks", _CHUNKS + """
, taken as (select *, coalesce(sum(words) over (partition by doc_id, chunk order by bi desc rows between unbounded preceding and 1 preceding), 0) t from walk)
select doc_id, bi, words, chunk from taken where t < 200""", recursive=True))  # fmt: skip
def w08(spark, sf):
    return assemble.context(assemble.chunks(_blocks(spark, sf)))


@query("w09_render_chunk", sql("blocks", _CHUNKS + """
select doc_id, chunk, sum(w.words)::bigint words, string_agg('[' || bi || '] ' || b.text, chr(10) order by bi) as body from walk w join blocks b using (doc_id, bi) group by 1, 2""", recursive=True))
def w09(spark, sf):
    found = _blocks(spark, sf)
    both = assemble.chunks(found).join(found.select("doc_id", "bi", "text"), ["doc_id", "bi"])
    line = F.concat(F.lit("["), F.col("bi").cast("string"), F.lit("] "), F.col("text"))
    grouped = both.groupBy("doc_id", "chunk").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("bi", line.alias("s")))).alias("l"))
    return grouped.select("doc_id", "chunk", "words", F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("body"))


@query("w11_plan_batches", """
with recursive sized as (select conv_id, row_number() over (partition by conv_id order by turn) n, turn, length(text) size from conversations),
walk(conv_id, turn, n, size, chunk, filled, held) as (
  select conv_id, turn, n, size, 0::bigint, size, 1 from sized where n = 1
  union all select s.conv_id, s.turn, s.n, s.size, case when (filled > 0 and filled + s.size > 600) or held + 1 > 4 then chunk + 1 else chunk end,
    case when (filled > 0 and filled + s.size > 600) or held + 1 > 4 then s.size else filled + s.size end, case when (filled > 0 and filled + s.size > 600) or held + 1 > 4 then 1 else held + 1 end
  from walk w join sized s on s.conv_id = w.conv_id and s.n = w.n + 1)
select conv_id, turn, size, chunk from walk""")  # fmt: skip
def w11(spark, sf):
    """The turns of a conversation as requests, in batches of at most 4 and 600 characters."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return assemble.greedy(rows, "size", 600, 4, "conv_id", "turn")


@query("w16_paragraphs", r"""
with p as (select doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') l from documents)
select doc_id, unnest(range(0, len(l)))::int n, unnest(l) as text from p""")  # fmt: skip
def w16(spark, sf):
    return assemble.paragraphs(table(spark, sf, "documents"))


@query("w25_sample_book", sql("blocks", r"""
, l as (select *, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') ws from blocks where kind = 'paragraph'), r as (
select *, row_number() over (partition by doc_id order by bi) - 1 r, count(*) over (partition by doc_id) n from l where len(ws) > 40)
select doc_id, r // greatest(1, n // 8) k, array_to_string(ws[1:120], ' ') as text from r where r % greatest(1, n // 8) = 0 and r // greatest(1, n // 8) < 8"""))
def w25(spark, sf):
    return assemble.sample(_blocks(spark, sf))


@query("j11_anchor_illustrations", sql("blocks", """
, b as (select doc_id, bi, max(bi // 4 + case when bi % 9 = 5 then 2 else 0 end) over (partition by doc_id order by bi) page from blocks)
, p as (select doc_id, k picture, k * 2 page from documents, unnest(range(4)) t(k))
select p.doc_id, picture, max(bi) "after" from p left join b on b.doc_id = p.doc_id and b.page <= p.page group by 1, 2"""))
def j11(spark, sf):
    docs = table(spark, sf, "documents")
    page = F.floor(F.col("bi") / 4) + F.when(F.col("bi") % 9 == 5, 2).otherwise(0)
    pictures = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")).alias("picture")).withColumn("page", F.col("picture") * 2)
    return assemble.anchors(blocks(docs).select("doc_id", "bi", page.alias("page")), pictures)


@query("w23_fit_columns", """
with c as (select l_orderkey table_id, l_linenumber, l_quantity::double nat from lineitem), s as (
select *, sum(nat) over w total, 80.0 / count(*) over w fair, greatest(10.0, least(nat, 80.0 / count(*) over w)) base from c window w as (partition by table_id)), t as (
select *, greatest(0, 80.0 - sum(base) over w) spare, sum(case when nat > fair then nat else 0 end) over w wanting from s window w as (partition by table_id))
select table_id, l_linenumber, round(case when total <= 80 then nat else base + case when wanting > 0 and nat > fair then spare * nat / wanting else 0 end end, 6) width from t""")
def w23(spark, sf):
    columns = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), "l_linenumber", F.col("l_quantity").cast("double").alias("natural"))
    return assemble.fit_columns(columns, 80, 10).select("table_id", "l_linenumber", F.round("width", 6).alias("width"))


_FACTS = """
with f as (select item_id fact_id, (item_id * 7) % (select count(*) from documents) block_id, text quote, ['stated', 'inferred', 'context'][item_id % 3 + 1] footing from benchmark),
facts as (select *, block_id // 50 book from f)
"""


def _facts(spark, sf):
    """Benchmark passages as quotations, each said to be from some document of a book."""
    n = table(spark, sf, "documents").count()
    block = (F.col("item_id") * 7) % n
    footing = F.element_at(F.array(F.lit("stated"), F.lit("inferred"), F.lit("context")), (F.col("item_id") % 3 + 1).cast("int"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("fact_id"), block.alias("block_id"), F.col("text").alias("quote"), footing.alias("footing"), book_of(block).alias("book"))


@query("j02_check_facts", _FACTS + r"""
, d as (select doc_id, doc_id // 50 book, trim(regexp_replace(text, '\s+', ' ', 'g')) t from documents), q as (select *, trim(regexp_replace(quote, '\s+', ' ', 'g')) q from facts)
, v as (select fact_id, bool_or((d.doc_id = q.block_id and contains(t, q)) or contains(lower(t), lower(q))) ok from q join d using (book) where quote <> '' group by 1)
select fact_id, book, block_id, coalesce(ok, false) quote_verified, case when footing = 'stated' and not coalesce(ok, false) then 'context' else footing end footing,
  case when footing = 'stated' and not coalesce(ok, false) then footing end demoted_from, case when coalesce(ok, false) then quote else '' end quote from facts left join v using (fact_id)""")
def j02(spark, sf):
    found = table(spark, sf, "documents").select(F.col("doc_id").alias("block_id"), book_of(F.col("doc_id")).alias("book"), "text")
    return facts.check(_facts(spark, sf), found)


@query("w26_dedupe_facts", """
select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id, role order by turn, text) r from conversations) where r = 1""")
def w26(spark, sf):
    return facts.first_per(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), ["conv_id", "role"], [F.col("turn"), F.col("text")])


@query("a09_tag_index", "select event_type tag, count(*) n from events group by 1")
def a09(spark, sf):
    return facts.tag_index(table(spark, sf, "events").select(F.col("event_type").alias("tag")))


@query("a08_group_by_category", """
select event_type category, count(*) n, min(event_id) first_seen from events group by 1""")
def a08(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@query("a24_grow_vocabulary", """
with t as (select lang tag, 1 n from documents union all select source, 1 from documents) select tag, sum(n)::bigint n from t group by 1""")
def a24(spark, sf):
    docs = table(spark, sf, "documents")
    count = lambda c: docs.groupBy(F.col(c).alias("tag")).agg(F.count("*").alias("n"))
    return facts.grown(count("lang"), count("source"))


@query("t_canonical_tags", """
with v as (select distinct p_type tag from part where p_partkey % 2 = 0), raw as (select p_partkey, case when p_partkey % 3 = 0 then p_type || 's' when p_partkey % 3 = 1 then ' ' || upper(replace(p_type, ' ', '_')) else p_type end tag from part),
n as (select p_partkey, lower(trim(replace(tag, '_', ' '))) t from raw), k as (select distinct lower(tag) tag from v)
select p_partkey, case when t in (select tag from k) then t when t || 's' in (select tag from k) then t || 's' when regexp_replace(t, 's$', '') in (select tag from k) then regexp_replace(t, 's$', '') else t end canonical from n where t <> ''""")
def canonical(spark, sf):
    part = table(spark, sf, "part")
    turn = F.col("p_partkey") % 3
    raw = F.when(turn == 0, F.concat("p_type", F.lit("s"))).when(turn == 1, F.concat(F.lit(" "), F.upper(F.translate("p_type", " ", "_")))).otherwise(F.col("p_type"))
    vocabulary = part.where("p_partkey % 2 = 0").select(F.lower("p_type").alias("tag")).distinct()
    return facts.canonical_tags(part.select("p_partkey", raw.alias("tag")), vocabulary).select("p_partkey", "canonical")


@query("k02_bank_jsonl", _FACTS + """
select fact_id, '{"fact_id":' || fact_id || ',"block_id":' || block_id || ',"footing":"' || footing || '"' || case when fact_id % 2 = 0 then ',"note":"n' || fact_id || '"' else '' end || '}' line from facts""")
def k02(spark, sf):
    found = _facts(spark, sf).withColumn("note", F.when(F.col("fact_id") % 2 == 0, F.concat(F.lit("n"), F.col("fact_id").cast("string"))))
    return facts.jsonl(found, ["fact_id", "block_id", "footing", "note"], "fact_id")


@query("k03_bank_markdown", _FACTS + """
select footing category, count(*) n, string_agg('- ' || quote[1:30] || ' (' || footing || ')', chr(10) order by fact_id) body from facts group by 1""")
def k03(spark, sf):
    return facts.markdown(_facts(spark, sf).select("fact_id", F.col("footing").alias("category"), "footing", F.substring("quote", 1, 30).alias("title")))


@query("w12_halt_watch", """
with n as (select user_id, event_type = 'error' ev, row_number() over (partition by user_id order by ts, event_id) n from events),
g as (select *, n - row_number() over (partition by user_id, ev order by n) grp from n), r as (select *, row_number() over (partition by user_id, grp order by n) rl from g where ev)
select user_id, min(n) stop_at from r where rl = 3 group by 1""")
def w12(spark, sf):
    return runs.halts(table(spark, sf, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") == "error", "failed").alias("message")))


def _edits(spark, sf):
    kinds = F.array(*map(F.lit, ["note", "image", "drop", "text", "split", "merge", "anchor"]))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("book"), F.col("event_id").alias("seq"), F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("kind"), F.floor(F.col("value") % 5).cast("long").alias("target")
    )


_EDITS = "with e as (select user_id book, event_id seq, ['note', 'image', 'drop', 'text', 'split', 'merge', 'anchor'][event_id % 7 + 1] kind, floor(value % 5)::bigint target from events)"


@query("w14_edit_upserts", _EDITS + """
select book, max(seq) seq, kind, target from e where kind in ('note', 'image', 'text', 'anchor') group by book, kind, target
union all select book, seq, kind, target from e where kind in ('drop', 'split', 'merge')""")
def w14(spark, sf):
    return runs.upserts(_edits(spark, sf))


@query("a16_count_edited", _EDITS + "select book, count(distinct target) targets from e group by 1")
def a16(spark, sf):
    return _edits(spark, sf).groupBy("book").agg(F.countDistinct("target").alias("targets"))


@query("a15_edit_summary", _EDITS + "select book, kind, count(*) n from e group by 1, 2")
def a15(spark, sf):
    return _edits(spark, sf).groupBy("book", "kind").agg(F.count("*").alias("n"))


@query("k06_retain_newest", "select user_id, event_id, ts from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r <= 10")
def k06(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return runs.retained(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 10)


@query("w29_last_exemplars", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by event_id desc) q from (select user_id, event_type, max(event_id) event_id from events group by 1, 2)) where q <= 6")
def w29(spark, sf):
    last = facts.last_per(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")
    return runs.retained(last, ["user_id"], [F.desc("event_id")], 6)


def _result_lines(spark, sf):
    ev = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "errored").otherwise("succeeded")
    good = F.to_json(F.struct(
        F.when(F.col("event_id") % 31 == 0, F.lit("other")).otherwise(T.custom_id(F.col("event_id"))).alias("custom_id"), kind.alias("type"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "too long").alias("error"), (F.col("event_id") % 900).alias("input"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 400).alias("output"),
    ))
    return ev.where("event_id % 17 <> 0").select(F.when(F.col("event_id") % 29 == 0, F.substring(good, 1, 20)).otherwise(good).alias("line"))


_RESULTS = """
with e as (select *, case when event_id % 31 = 0 then 'other' else 'page-' || case when length(event_id::varchar) >= 5 then event_id::varchar else lpad(event_id::varchar, 5, '0') end end custom_id from events where event_id % 17 <> 0 and event_id % 29 <> 0),
r as (select custom_id, case when custom_id <> 'other' then event_id end page, event_type <> 'error' ok, case when event_type = 'error' then case when event_id % 2 = 0 then 'too long' else 'the request errored' end end reason,
  event_id % 900 "input", case when event_id % 3 > 0 then event_id % 400 else 0 end "output" from e)
"""


@query("s20_batch_results", _RESULTS + "select * from r")
def s20(spark, sf):
    return runs.parse_results(_result_lines(spark, sf))


@query("s20_missing_pages", _RESULTS + "select event_id page from events where event_id not in (select page from r where page is not null)")
def s20_missing(spark, sf):
    return runs.missing(table(spark, sf, "events").select(F.col("event_id").alias("page")), runs.parse_results(_result_lines(spark, sf)))


@query("s20_usage", _RESULTS + """select count(case when ok then 1 end) succeeded, count(case when not ok then 1 end) failed, sum(case when ok then "input" end)::bigint "input", sum(case when ok then "output" end)::bigint "output" from r""")
def s20_usage(spark, sf):
    r = runs.parse_results(_result_lines(spark, sf))
    return r.agg(F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.when(F.col("ok"), F.col("input"))).alias("input"), F.sum(F.when(F.col("ok"), F.col("output"))).alias("output"))


@query("p41_recon_resume", """
with c as (select o_orderkey, 2 + o_orderkey % 2 version, case when o_orderkey % 5 = 0 then null else 300 end dpi, o_orderkey % 40 - 3 done, o_orderkey % 30 page_count from orders),
s as (select *, version = 3 and dpi is not distinct from 300 same from c)
select o_orderkey, case when same then least(page_count, greatest(0, done)) else 0 end resume, same and page_count > 0 and done >= page_count usable from s""")
def p41(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (2 + k % 2).alias("version"), F.when(k % 5 != 0, 300).alias("dpi"), F.lit(None).cast("int").alias("most"), (k % 40 - 3).alias("done"), (k % 30).alias("page_count"),
        F.lit(3).alias("want_version"), F.lit(300).alias("want_dpi"), F.lit(None).cast("int").alias("want_most"),
    )
    return runs.resume_from(rows).select("o_orderkey", "resume", "usable")


@query("s25_find_run", """
with s as (select p_name as name, p_size size, 'k' || p_partkey "key" from part), w as (select p_partkey want_id, p_name as name, p_size size, case when p_partkey % 3 = 0 then 'k' || p_partkey else 'none' end "key" from part),
u as (select want_id, 0 r, s.key from w join s using (key) union all select want_id, 1, s.key from w join s on w.name = s.name and w.size = s.size)
select want_id, arg_min("key", (r, "key")) "key" from u group by 1""")
def s25(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"))
    wanted = part.select(F.col("p_partkey").alias("want_id"), "name", "size", F.when(F.col("p_partkey") % 3 == 0, F.col("key")).otherwise("none").alias("key"))
    return runs.find_run(wanted, part.select("name", "size", "key"))


def _findings(spark, sf):
    ev = table(spark, sf, "events")
    severity = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("event_id") % 3 + 1).cast("int"))
    code = F.when(F.col("event_id") % 5 < 4, "text-dropped").otherwise("text-added")
    return ev.select((F.col("event_id") % 3000).alias("page"), severity.alias("severity"), code.alias("code"), "event_id")


_FIND = """with f as (select event_id % 3000 page, ['high', 'medium', 'low'][event_id % 3 + 1] severity, case when event_id % 5 < 4 then 'text-dropped' else 'text-added' end code, event_id from events)"""


@query("a05_findings_summary", _FIND + """
select count(case when severity = 'high' then 1 end) high, count(case when severity = 'medium' then 1 end) medium, count(case when severity = 'low' then 1 end) low, greatest(0, 4000 - count(distinct page)) clean_pages from f""")
def a05(spark, sf):
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    return _findings(spark, sf).agg(*map(count, ("high", "medium", "low")), F.greatest(F.lit(0), 4000 - F.countDistinct("page")).alias("clean_pages"))


@query("a06_pages_needing_review", _FIND + "select distinct page from f where severity in ('high', 'medium') union select doc_id from documents where doc_id % 97 = 0")
def a06(spark, sf):
    bad = _findings(spark, sf).where(F.col("severity").isin("high", "medium")).select("page")
    return bad.union(table(spark, sf, "documents").where("doc_id % 97 = 0").select("doc_id")).distinct()


@query("a18_messages_by_page", _FIND + "select page, list(code || '-' || event_id order by case severity when 'high' then 0 else 1 end, event_id) messages from f where severity <> 'low' group by 1")
def a18(spark, sf):
    said = F.struct(F.when(F.col("severity") == "high", 0).otherwise(1).alias("r"), "event_id", F.concat_ws("-", "code", "event_id").alias("m"))
    grouped = _findings(spark, sf).where("severity <> 'low'").groupBy("page").agg(F.array_sort(F.collect_list(said)).alias("l"))
    return grouped.select("page", F.transform("l", lambda x: x["m"]).alias("messages"))


@query("j17_settled_leaves", _FIND + """
, o as (select page from f where severity <> 'low' group by 1 having bool_and(code = 'text-dropped')), s as (select event_id % 3000 page, event_id % 7 < 6 v from events), j as (select page from s group by 1 having bool_and(v))
select page from o join j using (page) where page not in (select doc_id from documents where doc_id % 11 = 0)""")
def j17(spark, sf):
    spots = table(spark, sf, "events").select((F.col("event_id") % 3000).alias("page"), F.when(F.col("event_id") % 7 < 6, "not-there").alias("verdict"))
    uncertain = table(spark, sf, "documents").where("doc_id % 11 = 0").select(F.col("doc_id").alias("page"))
    return runs.settled(_findings(spark, sf), spots, uncertain)


@query("w18_next_flagged_page", sql("pages_", """
, g as (select book, page_index, (doc_id * 7) % 10 = 3 flagged from pages_), m as (select book, min(page_index) f from g where flagged group by 1)
select book, page_index, coalesce(min(case when flagged then page_index end) over (partition by book order by page_index rows between 1 following and unbounded following), f) next_flagged from g left join m using (book)"""))
def w18(spark, sf):
    from pyspark.sql import Window

    book = Window.partitionBy("book")
    flagged = F.when((F.col("doc_id") * 7) % 10 == 3, F.col("page_index"))
    later = F.min(flagged).over(book.orderBy("page_index").rowsBetween(1, Window.unboundedFollowing))
    return page_view(table(spark, sf, "documents")).select("book", "page_index", F.coalesce(later, F.min(flagged).over(book)).alias("next_flagged"))


@query("a07_merge_metadata", sql("pages_", """
select book, arg_min(trim(lang), page_index) filter (page_index % 4 > 0) as "language", arg_min(source, page_index) filter (page_index % 6 > 2) publisher from pages_ group by 1"""))
def a07(spark, sf):
    view = page_view(table(spark, sf, "documents"))
    first = lambda v, c, a: F.min_by(v, F.when(c, F.col("page_index"))).alias(a)
    return view.groupBy("book").agg(first(F.trim("lang"), F.col("page_index") % 4 > 0, "language"), first(F.col("source"), F.col("page_index") % 6 > 2, "publisher"))


@query("a10_book_totals", sql("blocks", r"""
select doc_id // 50 book, count(*) n_blocks, sum(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')))::bigint words, count(case when kind = 'footnote' then 1 end) notes from blocks group by 1"""))
def a10(spark, sf):
    return _blocks(spark, sf).groupBy(book_of(F.col("doc_id")).alias("book")).agg(F.count("*").alias("n_blocks"), F.sum(T.word_count(F.col("text"))).alias("words"), F.count_if(F.col("kind") == "footnote").alias("notes"))


@query("j13_proof_sheet", sql("blocks", """
, b as (select doc_id page, count(*) n_blocks from blocks where doc_id % 5 <> 0 group by 1), m as (select event_id % 1500 page, count(*) marks, count(distinct event_type) kinds from events where event_type <> 'view' group by 1),
p as (select page from b union select page from m)
select page, coalesce(n_blocks, 0) n_blocks, coalesce(marks, 0) marks, coalesce(kinds, 0) kinds, coalesce(marks, 0) > 0 and page % 3 <> 0 flagged from p left join b using (page) left join m using (page)"""))
def j13(spark, sf):
    found = _blocks(spark, sf).where("doc_id % 5 <> 0").groupBy(F.col("doc_id").alias("page")).agg(F.count("*").alias("n_blocks"))
    marks = table(spark, sf, "events").where("event_type <> 'view'").groupBy((F.col("event_id") % 1500).alias("page")).agg(F.count("*").alias("marks"), F.countDistinct("event_type").alias("kinds"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = found.join(marks, "page", "full_outer").select("page", *(zero(c).alias(c) for c in ("n_blocks", "marks", "kinds")))
    return both.withColumn("flagged", (F.col("marks") > 0) & (F.col("page") % 3 != 0))


@query("j15_unanswered", "select event_id from events where event_id % 2 = 0 and event_id not in (select event_id from events where event_id % 6 = 0)")
def j15(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    return ev.where("event_id % 2 = 0").join(ev.where("event_id % 6 = 0"), "event_id", "left_anti")


@query("k08_content_address", "select doc_id, substring(sha256(text), 1, 32) || '.pdf' path from documents d where doc_id = (select min(doc_id) from documents e where e.text = d.text)")
def k08(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.concat(F.substring("h", 1, 32), F.lit(".pdf")).alias("path"))


@query("t01_inline_markup", sql("blocks", r"select doc_id, bi, text as plain, case when length(text) > 0 then '<i>' || text || '</i>' else '' end again, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::int n_marked from blocks where bi % 2 = 1"))
def t01(spark, sf):
    """Every other block set in italics, read back to text and marked words, and written again."""
    raw = F.concat(F.lit("<em>"), F.col("text"), F.lit("</em>"))
    rows = _blocks(spark, sf).where("bi % 2 = 1").select("doc_id", "bi", markup.parsed_markup(raw).alias("m"))
    return rows.select("doc_id", "bi", F.col("m.text").alias("plain"), markup.with_markup(F.col("m.text"), F.col("m.emphasis")).alias("again"), F.size("m.emphasis").alias("n_marked"))


@query("p13_normalized_markup", sql("blocks", r"""
select doc_id, bi, text, case when kind = 'paragraph' and length(text) > 0 then [0] else [3] end emphasis from blocks"""))
def p13(spark, sf):
    """Blocks with emphasis of their own; paragraphs come with a tag around their first word, other blocks with one that means nothing."""
    first = F.regexp_extract("text", r"^\S+", 0)
    raw = F.when(F.col("kind") == "paragraph", F.concat(F.lit("<em>"), first, F.lit("</em>"), F.expr("substring(text, length(regexp_extract(text, '^\\\\S+', 0)) + 1)"))).otherwise(F.concat(F.lit("<b>"), F.col("text"), F.lit("</b>")))
    return _blocks(spark, sf).select("doc_id", "bi", markup.normalized_markup(raw, F.array(F.lit(3))).alias("m")).select("doc_id", "bi", "m.text", "m.emphasis")


@query("t14_anchor_ends", sql("blocks", r"""
select doc_id, bi, length(regexp_extract(text, '^\s*(\S+\s+){0,4}\S+'))::int "at" from blocks"""))
def t14(spark, sf):
    """Where each block's first five words, found with loose white space, end in it."""
    rows = _blocks(spark, sf)
    first = F.array_join(F.slice(F.filter(F.split("text", r"\s+"), lambda x: x != ""), 1, 5), " ")
    return rows.select("doc_id", "bi", markup.anchor_end(F.col("text"), first).alias("at"))


@query("t15_claims", r"""
with s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) sentence from documents),
w as (select doc_id, unnest(l) w, unnest(range(0, len(l))) k from (select doc_id, regexp_extract_all(sentence, '\d[\d,.]*\d|\d|\p{L}[\p{L}\p{N}_''’-]*') l from s)),
c as (select distinct doc_id, w claim from w where regexp_matches(w, '^\d') or (k > 0 and regexp_matches(w, '^\p{Lu}') and length(w) >= 2))
select c.doc_id, claim, coalesce(not contains(lower(trim(regexp_replace(d.text, '\s+', ' ', 'g'))), lower(claim)), true) outside from c left join documents d on d.doc_id = c.doc_id + 1""")
def t15(spark, sf):
    """Numbers and names that each document states, and whether the book's next document has them too."""
    docs = table(spark, sf, "documents")
    rows = docs.select("doc_id", F.explode(markup.claims_in(F.col("text"))).alias("claim"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.lower(T.collapse(F.col("text"))).alias("t"))
    return rows.join(after, "doc_id", "left").select("doc_id", "claim", F.coalesce(~F.contains("t", F.lower("claim")), F.lit(True)).alias("outside"))


_SLUG = r"rtrim(ltrim(regexp_replace(lower(trim(url)), '[^\p{L}\p{N}]+', '-', 'g'), '-'), '-')[1:48]"


@query("p33_shelf_names", r"""
with h as (select page_id, url, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(url, ''), lambda c: ascii(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) h from pages),
b as (select *, list_reduce(list_transform(range(6, -1, -1), lambda k: substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // (36 ** k)::bigint) % 36 + 1)::int, 1)), lambda a, c: a || c) digits from h)
select page_id, SLUG || '-' || case when h = 0 then '0' else ltrim(digits, '0') end as name from b""".replace("SLUG", _SLUG))
def p33(spark, sf):
    """A short hash of each page's address, for its place on the shelf."""
    return table(spark, sf, "pages").select("page_id", F.concat_ws("-", T.slug(F.col("url")), markup.short_hash(F.col("url"))).alias("name"))
