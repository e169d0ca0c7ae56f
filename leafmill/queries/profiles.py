"""Profiles, editions, voices, replies and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profiles
from ..plans.views import blocks, ocr_words, second_reading, sql, table, tokens

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


@query("p36_editions", """
with i as (select p_partkey, case p_partkey % 3 when 0 then '  ' when 1 then ' ' || p_name end t, case when p_partkey % 4 > 0 then p_brand else '' end a, case when p_partkey % 5 > 0 then (1800 + p_partkey % 150)::varchar end y from part)
select p_partkey, coalesce(nullif(trim(t), ''), 'Untitled') title, nullif(trim(a), '') author, 'First published ' || nullif(trim(y), '') || ', by ' || nullif(trim(a), '') notice from i""")
def p36(spark, sf):
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" "), "p_name"))
    e = profiles.edition(title, F.when(k % 4 > 0, F.col("p_brand")).otherwise(""), F.when(k % 5 > 0, (1800 + k % 150).cast("string")))
    return table(spark, sf, "part").select(k, e.alias("e")).select("p_partkey", "e.*")


_STYLES = """
with i as (select p_partkey id, case when p_partkey % 3 = 0 then '5x8' when p_partkey % 3 = 1 then ' ' end t, case when p_partkey % 2 = 0 then 9.5::double end s, case when p_partkey % 4 = 0 then 0.5::double end m, case when p_partkey % 5 = 0 then true end d from part),
s as (select id, coalesce(nullif(trim(t), ''), '6x9') trim_, coalesce(s, 11.0::double) size, coalesce(m, 0.75::double) "inner_", coalesce(d, false) drop_caps from i)
"""


@query("p43_styles", _STYLES + """select id, trim_ as "trim", size, inner_ as "inner", drop_caps, concat_ws(' · ', trim_, (case when size = 11 then '11.0' else '9.5' end) || ' pt', case when drop_caps then 'drop caps' end) said from s""")
def p43(spark, sf):
    k = F.col("p_partkey")
    margins = F.when(k % 4 == 0, F.struct(F.lit(0.5).alias("inner")))
    body = F.to_json(F.struct(F.when(k % 3 == 0, "5x8").when(k % 3 == 1, " ").alias("trimSize"), F.when(k % 2 == 0, 9.5).alias("bodyFontSize"), margins.alias("margins"), F.when(k % 5 == 0, F.lit(True)).alias("dropCaps")))
    s = F.col("s")
    rows = table(spark, sf, "part").select(k.alias("id"), profiles.style(body).alias("s"))
    return rows.select("id", s["trim"].alias("trim"), s["size"].alias("size"), s["inner"].alias("inner"), s["drop_caps"].alias("drop_caps"), profiles.described(s).alias("said"))


@query("p52_voices", """
with v as (select conv_id, count(*)::int n, list(text order by turn) e, list(distinct role) filter (conv_id % 3 > 0) k from conversations group by 1)
select conv_id, least(120, greatest(10, n * 7)) most_words, len(coalesce(nullif(k, []), ['context']))::int n_kinds, case when n > 6 then e[n - 5:n] else e end exemplars from v""")
def p52(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count("*").cast("int").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("e"), F.collect_set(F.when(F.col("conv_id") % 3 > 0, F.col("role"))).alias("k")
    )
    v = rows.select("conv_id", profiles.voice(F.col("k"), F.col("n") * 7, F.col("e")).alias("v"))
    return v.select("conv_id", F.col("v.most_words"), F.size("v.kinds").alias("n_kinds"), F.col("v.exemplars"))


@query("p56_running_heads", sql("blocks", r"""
, h as (select doc_id, text t, 20 w from blocks where kind = 'heading'), p as (select *, trim(regexp_extract(t, '^[^:;]*')) part from h), b as (select *, regexp_replace(part, '(?i)^(the|a|an) ', '') bare from p),
s as (select *, string_split(bare, ' ') ws from b)
select doc_id, case when length(t) * 0.5 <= w then t when length(part) * 0.5 <= w then part when length(bare) * 0.5 <= w then bare else coalesce(list_filter(list_transform(range(len(ws), 0, -1), lambda n: array_to_string(ws[1:n], ' ') || '…'), lambda x: length(x) * 0.5 <= w)[1], bare[1:39] || '…') end head from s"""))
def p56(spark, sf):
    return blocks(table(spark, sf, "documents")).where("kind = 'heading'").select("doc_id", profiles.running_head(F.col("text"), F.lit(20)).alias("head"))


@query("p64_extract_json", """
with i as (select event_id, event_id % 6 k, props from events)
select event_id, case when k not in (1, 2, 3) then props end as "json", case k when 1 then 'refused' when 2 then 'no text' when 3 then 'bad json' end reason, k = 3 retry from i""")
def p64(spark, sf):
    k = F.col("event_id") % 6
    text = F.struct(F.lit("text").alias("type"), F.when(k == 3, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("text"))
    other = F.struct(F.lit("thinking").alias("type"), F.lit("hm").alias("text"))
    body = F.to_json(F.struct(F.when(k == 1, "refusal").otherwise("end_turn").alias("stop_reason"), F.when(k == 2, F.array(other)).otherwise(F.array(other, text)).alias("content")))
    return table(spark, sf, "events").select("event_id", profiles.extract_json(body).alias("r")).select("event_id", "r.*")


@query("w35_active_step", """
with s as (select conv_id run, turn pos, 's' || turn step, (conv_id + turn) % 3 = 0 done, (conv_id * 7 + turn) % 4 = 1 enter from conversations)
select run, arg_min(step, case when not done and enter then pos when not done then 1000 + pos else 100000 - pos end) step from s group by 1""")
def w35(spark, sf):
    run, pos = F.col("conv_id"), F.col("turn")
    return profiles.active_step(table(spark, sf, "conversations").select(run.alias("run"), pos.alias("pos"), F.concat(F.lit("s"), pos.cast("string")).alias("step"), ((run + pos) % 3 == 0).alias("done"), ((run * 7 + pos) % 4 == 1).alias("can_enter")))


_ANNOTATIONS = """
with a as (select event_id id, event_id * 3 % 2000 block_id, case when event_id % 7 > 0 then 'here' else ' ' end anchor, case when event_id % 5 > 0 then event_type end as text, ['person', 'other', 'obsolete-science'][event_id % 3 + 1] kind from events),
g as (select *, trim(anchor) <> '' and text is not null and block_id in (select doc_id from documents) good from a)
"""


def _annotations(spark, sf):
    i = F.col("event_id")
    raw = table(spark, sf, "events").select(
        i.alias("id"), (i * 3 % 2000).alias("block_id"), F.when(i % 7 > 0, "here").otherwise(" ").alias("anchor"), F.when(i % 5 > 0, F.col("event_type")).alias("text"),
        F.element_at(F.array(*map(F.lit, ["person", "other", "obsolete-science"])), (i % 3 + 1).cast("int")).alias("kind"),
    )
    return profiles.known_annotations(raw, table(spark, sf, "documents").select(F.col("doc_id").alias("block_id")))


@query("w37_known_annotations", _ANNOTATIONS + "select id, block_id, anchor, text, case when kind = 'other' then 'context' else kind end kind from g where good")
def w37(spark, sf):
    return _annotations(spark, sf)[0]


@query("w37_dropped_annotations", _ANNOTATIONS + "select count(case when not coalesce(good, false) then 1 end) dropped from g")
def w37_dropped(spark, sf):
    return _annotations(spark, sf)[1]


@query("t18_hanging_marks", sql("blocks", """
select doc_id, bi, (case when text[1] in ('“', '"', '‘', '''') then 0.5 when text[1] in ('.', ',', '-') then 0.7 when text[1] in (';', ':', '!', '?', '”', '’') then 0.4 else 0 end)::double * 0.5 shift_left,
 (case when text[-1] in ('“', '"', '‘', '''') then 0.5 when text[-1] in ('.', ',', '-') then 0.7 when text[-1] in (';', ':', '!', '?', '”', '’') then 0.4 else 0 end)::double * 0.5 shift_right from blocks"""))
def t18(spark, sf):
    return profiles.hang(blocks(table(spark, sf, "documents")))


@query("j01_pages_with_scans", sql("tok ocr rd", """
, r as (select distinct doc_id, ((pos - 1) // 250)::bigint page_index from rd), s as (select doc_id, page_index, count(*) n from ocr where (doc_id + page_index) % 4 > 0 group by 1, 2)
select doc_id, page_index, coalesce(n, 0) n_scanned from r left join s using (doc_id, page_index)"""))
def j01(spark, sf):
    tok = tokens(table(spark, sf, "documents"))
    reads = second_reading(tok).select("doc_id", F.floor((F.col("pos") - 1) / 250).cast("long").alias("page_index")).distinct()
    scans = ocr_words(tok).where("(doc_id + page_index) % 4 > 0").groupBy("doc_id", "page_index").agg(F.count("*").alias("n_scanned"))
    return profiles.joined_pages(reads, scans)


@query("t03_shift_emphasis", "select conv_id, list(turn + 10 order by turn) marks from conversations group by 1")
def t03(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: x + 10).alias("marks"))
