"""Saved records, tickets, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records
from ..plans.views import ocr_words, sql, table, tokens

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


@query("p53_figure_columns", """
with c as (select l_orderkey, list(case when l_linenumber % 3 = 0 then ' ' when l_orderkey % 4 = 0 then l_returnflag || l_quantity else l_quantity::varchar end) v from lineitem group by 1)
select l_orderkey, len(list_filter(v, lambda x: trim(x) <> '')) > 0 and len(list_filter(v, lambda x: trim(x) <> '' and (not regexp_matches(x, '[0-9]') or regexp_matches(x, '\\p{L}')))) = 0 figures from c""")
def p53(spark, sf):
    cell = F.when(F.col("l_linenumber") % 3 == 0, " ").when(F.col("l_orderkey") % 4 == 0, F.concat("l_returnflag", F.col("l_quantity").cast("string"))).otherwise(F.col("l_quantity").cast("string"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(cell).alias("v")).select("l_orderkey", records.is_figure_column(F.col("v")).alias("figures"))


@query("s08_looks_scanned", sql("tok ocr", """
, p as (select doc_id, page_index, ((doc_id * 17 + page_index * 29) % 100) / 100 covered, sum(length(text))::double tl from ocr group by 1, 2)
, s as (select *, greatest(1, count(*) over w // least(8, count(*) over w)) step from p window w as (partition by doc_id))
select doc_id, count(*) sampled, count(case when covered >= .66 then 1 end) * 2 > count(*) scanned, round(avg(tl), 6) mean_text from s where page_index % step = 0 and page_index // step < 8 group by 1"""))
def s08(spark, sf):
    words = ocr_words(tokens(table(spark, sf, "documents")))
    pages = words.groupBy("doc_id", "page_index").agg(F.sum(F.length("text")).alias("text_length")).withColumn("covered", ((F.col("doc_id") * 17 + F.col("page_index") * 29) % 100) / 100)
    return records.looks_scanned(pages).withColumn("mean_text", F.round("mean_text", 6))


@query("a13_ticket_summary", """
with b as (select user_id, event_id // 25 k, list(event_id % 40 order by event_id) pages, bool_or(event_type = 'purchase') c, min(ts) t from events group by 1, 2),
t as (select user_id ticket_id, min(t) submitted, list(pages) pl, count(*)::int n_batches, count(case when not c then 1 end)::int n_pending from b group by 1)
select ticket_id, list_sort(list_distinct(flatten(pl))) pages, n_batches, n_pending, submitted + interval 29 day expires from t""")
def a13(spark, sf):
    ev = table(spark, sf, "events")
    batch = ev.groupBy("user_id", F.floor(F.col("event_id") / 25).alias("k")).agg(F.collect_list(F.col("event_id") % 40).alias("pages"), F.bool_or(F.col("event_type") == "purchase").alias("collected"), F.min("ts").alias("t"))
    tickets = batch.groupBy(F.col("user_id").alias("ticket_id")).agg(F.collect_list(F.struct("pages", "collected")).alias("batches"), F.min("t").alias("submitted"))
    return records.ticket_summary(tickets)


@query("a22_checkpoint_left", """
with c as (select o_orderkey id, (o_orderkey % 12)::int done, (o_orderkey % 15)::int total, o_orderkey % 4 k from orders),
f as (select *, list_filter([case when k > 0 then 1 end, case when k > 1 then 3 end], lambda x: x is not null) failed, case when k = 0 then 0 when k = 1 then 1 when k = 2 then 1 else 2 end nr from c),
r as (select *, len(list_filter(range(0, done), lambda x: not list_contains(failed, x)))::int n_read from f)
select id, n_read, (total - n_read)::int n_left, case when nr = 1 then 'refused' end failed_because, total > 0 and done >= total and len(failed) = 0 complete from r""")
def a22(spark, sf):
    k = F.col("o_orderkey")
    one = lambda c, m: F.struct(F.lit(c).alias("chunk"), F.lit(m).alias("message"))
    none = F.array().cast("array<struct<chunk:int,message:string>>")
    failed = F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(one(1, "refused"))).when(k % 4 == 2, F.array(one(1, "refused"), one(3, "refused"))).otherwise(F.array(one(1, "refused"), one(3, "late")))
    rows = table(spark, sf, "orders").select(k.alias("id"), (k % 12).cast("int").alias("done"), (k % 15).cast("int").alias("total"), failed.alias("failed"))
    return records.checkpoint_left(rows)


@query("w27_adjudications", """
with a as (select event_id % 700 spot_id, event_id pos, ['present', 'not-there', 'maybe', 'unclear'][event_id % 4 + 1] verdict, event_type reading from events),
g as (select *, row_number() over (partition by spot_id order by pos) r from a where verdict <> 'maybe' and spot_id % 3 <> 0)
select spot_id, verdict, case when verdict = 'not-there' then '' else reading end reading from g where r = 1""")
def w27(spark, sf):
    said = F.element_at(F.array(*map(F.lit, ["present", "not-there", "maybe", "unclear"])), (F.col("event_id") % 4 + 1).cast("int"))
    answers = table(spark, sf, "events").select((F.col("event_id") % 700).alias("spot_id"), F.col("event_id").alias("pos"), said.alias("verdict"), F.col("event_type").alias("reading"))
    return records.adjudications(answers, answers.where("spot_id % 3 <> 0"))


def _answers(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("question"), F.when(F.col("event_id") % 5 == 0, " ").otherwise((F.col("event_id") % 9).cast("string")).alias("value"))


def _questions(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("question")).distinct().where("question <> 'view'").withColumn("required", F.col("question") != "click")


_ANSWERS = "with a as (select user_id run, event_type question, case when event_id % 5 = 0 then ' ' else (event_id % 9)::varchar end \"value\" from events), q as (select distinct event_type question from events where event_type <> 'view')"


@query("p60_prune_answers", _ANSWERS + """
select run, question, "value" from a where question not in (select question from q) or "value" in ('1', '2', '3', '4')""")
def p60(spark, sf):
    questions = _questions(spark, sf)
    options = questions.select("question", F.explode(F.array(*map(F.lit, "1234"))).alias("value"))
    return records.prune_answers(_answers(spark, sf), options, questions)


@query("p61_missing_required", _ANSWERS + """
, r as (select distinct run from a where run % 2 = 0 or "value" <> ' ')
select run, question from r, q where question <> 'click' and not exists (select 1 from a where a.run = r.run and a.question = q.question and trim("value") <> '' and event_ok) """.replace(" and event_ok", " and a.run % 3 > 0"))
def p61(spark, sf):
    answers = _answers(spark, sf)
    runs = answers.where("run % 2 = 0 or value <> ' '")
    return records.missing_required(answers.where("run % 3 > 0"), _questions(spark, sf), runs)


@query("p44_merge_style", """
select p_partkey, coalesce(case when p_partkey % 2 = 0 then 11 end, 10) size, coalesce(case when p_partkey % 3 = 0 then p_brand end, 'plain') face, coalesce(case when p_partkey % 5 = 0 then 0.25::double end, 0.5::double) gutter from part""")
def p44(spark, sf):
    k = F.col("p_partkey")
    patch = F.struct(F.when(k % 2 == 0, 11).alias("size"), F.when(k % 3 == 0, F.col("p_brand")).alias("face"), F.when(k % 5 == 0, 0.25).alias("gutter"))
    base = F.struct(F.lit(10).alias("size"), F.lit("plain").alias("face"), F.lit(0.5).alias("gutter"))
    return table(spark, sf, "part").select("p_partkey", records.merge_style(base, patch, ["size", "face", "gutter"]).alias("s")).select("p_partkey", "s.*")


@query("w34_question_groups", """
with q as (select conv_id form, turn pos, turn || role question, case when turn % 3 = 1 then role end "name" from conversations),
l as (select *, sum((lag("name") over w is not null or lag(pos) over w is null)::int) over w k from (select *, lag("name") over (partition by form order by pos) pn, lag(pos) over (partition by form order by pos) pp from q) window w as (partition by form order by pos)),
t as (select form, pos, question, "name", coalesce('n:' || "name", 'l:' || k) tag from l),
g as (select form, tag, min(pos) f, max("name") "name", list(question order by pos) questions from t group by 1, 2)
select form, (row_number() over (partition by form order by f))::int group_no, "name", questions from g""".replace('sum((lag("name") over w is not null or lag(pos) over w is null)::int)', "sum((pn is not null or pp is null)::int)"))
def w34(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("form"), F.col("turn").alias("pos"), F.concat(F.col("turn").cast("string"), "role").alias("question"), F.when(F.col("turn") % 3 == 1, F.col("role")).alias("name"))
    return records.question_groups(rows.select("form", "pos", "question", "name"))


@query("j16_pages_to_render", sql("tok ocr", """
, c as (select lower(text) w, count(*) n, min({'d': doc_id, 'p': pos}) f from ocr group by 1 order by n desc, w limit 60)
select distinct o.doc_id, o.page_index from c join ocr o on o.doc_id = c.f.d and o.pos = c.f.p"""))
def j16(spark, sf):
    """The pages with the first appearance of the sixty most frequent words (a report's top sixty)."""
    words = ocr_words(tokens(table(spark, sf, "documents")))
    counts = words.groupBy(F.lower("text").alias("w")).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "page_index")).alias("f"))
    return counts.orderBy(F.desc("n"), "w").limit(60).select("f.doc_id", "f.page_index").distinct()


@query("j07_by_token_id", sql("tok ocr", """
select word_no || text token_id, max({'d': doc_id, 'p': pos}).d doc_id, max({'d': doc_id, 'p': pos}).p pos from ocr group by 1"""))
def j07(spark, sf):
    words = ocr_words(tokens(table(spark, sf, "documents")))
    last = words.groupBy(F.concat(F.col("word_no").cast("string"), "text").alias("token_id")).agg(F.max(F.struct("doc_id", "pos")).alias("m"))
    return last.select("token_id", "m.doc_id", "m.pos")
