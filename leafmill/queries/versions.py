"""Stored records of every age and shape, made of the conversations' turns, read as variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import versions
from ..plans.views import table

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def _turns(spark, sf) -> DataFrame:
    """conv_id, l: a conversation's turns in order."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    return rows.select(F.col("conv_id").alias("id"), "l")


def _json(*pairs: tuple[str, object]) -> F.Column:
    """An object of columns that hold JSON, those that are null left out."""
    parts = [F.concat(F.lit(f'"{k}":'), v if isinstance(v, F.Column) else F.lit(v)) for k, v in pairs]
    return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))


def _quoted(text) -> F.Column:
    return F.regexp_replace(F.to_json(F.struct(text.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")


def _list(each) -> F.Column:
    return F.concat(F.lit("["), F.array_join(F.transform("l", each), ","), F.lit("]"))


_MADE = "with t as (select conv_id id, turn, role, text, length(text) n from conversations)\n"


@query("p62_batch_tickets", _MADE + """
, b as (select id, count(*) filter (n % 5 <> 0 and n % 7 <> 0) batches, coalesce(sum(2) filter (n % 5 <> 0 and n % 7 <> 0), 0)::bigint pages, count(*) filter (n % 5 <> 0 and n % 7 <> 0 and n % 2 = 0) collected, sum(n)::bigint s, count(*) c,
  count(*) filter (n % 3 <> 0) corrections from t group by id)
select id, id || ' key' as "key", case when s % 2 = 0 then 'file ' || id else 'a book' end file_name, '1970-01-01T00:00:00.000Z' submitted_at, 'unknown' model_id, case when s % 5 = 0 then 0 else c end page_count, s % 4 = 1 complete,
  batches, pages, collected, corrections from b where s % 11 not in (3, 4) and batches > 0""")
def p62(spark, sf):
    """Tickets whose batches are turns: some ids are numbers or empty, some pages no whole numbers, some fields of another type."""
    n = lambda x: F.length(x["text"])
    batch = lambda x: _json(
        ("id", F.when(n(x) % 5 == 0, F.lit("7")).when(n(x) % 7 == 0, F.lit('""')).otherwise(F.concat(F.lit('"b'), x["turn"].cast("string"), F.lit('"')))),
        ("pageIndexes", F.concat(F.lit("["), x["turn"].cast("string"), F.lit(',"x",1.5,null,2]'))), ("collected", F.when(n(x) % 2 == 0, "true").otherwise('"true"')),
    )
    said = lambda x: _json(("from", F.when(n(x) % 3 == 0, F.lit("3")).otherwise(_quoted(x["role"]))), ("to", _quoted(x["role"])))
    s = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + n(x))
    body = _json(
        ("key", F.when(s % 11 == 3, F.lit("5")).otherwise(F.concat(F.lit('"'), F.col("id").cast("string"), F.lit(' key"')))), ("fileName", F.when(s % 2 == 0, F.concat(F.lit('"file '), F.col("id").cast("string"), F.lit('"'))).otherwise("[]")),
        ("submittedAt", "17"), ("pageCount", F.when(s % 5 == 0, F.lit('"many"')).otherwise(F.size("l").cast("string"))), ("complete", F.when(s % 4 == 1, "true").otherwise("1")),
        ("batches", _list(batch)), ("termCorrections", _list(said)),
    )
    found = versions.tickets(_turns(spark, sf).select("id", F.when(s % 11 == 4, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("body")))
    pages = F.aggregate("batches", F.lit(0).cast("long"), lambda a, b: a + F.size(b["pages"]))
    return found.select(
        "id", "key", "file_name", "submitted_at", "model_id", "page_count", "complete", F.size("batches").cast("long").alias("batches"), pages.alias("pages"),
        F.size(F.filter("batches", lambda b: b["collected"])).cast("long").alias("collected"), F.size("corrections").cast("long").alias("corrections"),
    )


@query("p63_checkpoints", _MADE + """
, c as (select id, count(*) k, sum(n)::bigint s, count(*) filter (n = 0 or role not in ('user', 'assistant')) bad, string_agg(text, '|' order by turn) texts from t group by id)
select id, 'k' || id as "key", 'body' body_key, case when s % 2 = 0 then 'facts' else 'notes' end mode, k chunks_done, case when s % 3 = 0 then 0 else 9 end chunks_total, k::int n_proposals, sha256(texts) texts_sha256, k::int n_facts, case when s % 3 = 0 then '' else 'late' end failed, s input_tokens
from c where s % 5 <> 1 and s % 7 <> 2 and bad = 0""")
def p63(spark, sf):
    """Checkpoints whose proposals are turns: of another version, without a part, or with a note of no known kind."""
    n = lambda x: F.length(x["text"])
    kind = lambda x: F.when(x["role"] == "user", '"context"').when(x["role"] == "assistant", '"concept"').otherwise('"opinion"')
    proposal = lambda x: _json(("blockId", F.concat(F.lit('"b'), x["turn"].cast("string"), F.lit('"'))), ("kind", kind(x)), ("text", _quoted(x["text"])))
    s = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + n(x))
    failure = F.when(s % 3 == 0, F.lit('{"chunkIndex":"1","message":4}')).otherwise('{"chunkIndex":1,"message":"late"}')
    body = _json(
        ("version", F.when(s % 5 == 1, F.lit("0")).otherwise("1")), ("key", F.concat(F.lit('"k'), F.col("id").cast("string"), F.lit('"'))), ("bodyKey", '"body"'), ("mode", F.when(s % 2 == 0, F.lit('"facts"')).otherwise('"notes"')),
        ("chunksDone", F.size("l").cast("string")), ("chunksTotal", F.when(s % 3 == 0, F.lit('"9"')).otherwise("9")), ("proposals", _list(proposal)), ("facts", F.when(s % 7 == 2, F.lit("{}")).otherwise(_list(lambda x: F.lit("{}")))),
        ("failures", F.concat(F.lit("["), failure, F.lit("]"))), ("usage", _json(("inputTokens", s.cast("string")))),
    )
    found = versions.checkpoints(_turns(spark, sf).select("id", body.alias("body")))
    texts = F.array_join(F.transform("proposals", lambda p: p["text"]), "|")
    return found.select(
        "id", "key", "body_key", "mode", "chunks_done", "chunks_total", F.size("proposals").alias("n_proposals"), F.sha2(texts, 256).alias("texts_sha256"), "n_facts", F.col("failures")[0]["message"].alias("failed"), "input_tokens"
    )


def _runs(spark, sf) -> DataFrame:
    n = lambda x: F.length(x["text"])
    fact = lambda x: F.when(n(x) % 9 == 8, F.lit("null")).otherwise(_json(
        ("id", F.concat(F.lit('"f'), x["turn"].cast("string"), F.lit('"'))), ("title", _quoted(x["text"])), ("footing", F.when(n(x) % 4 == 0, F.lit('"guessed"')).when(n(x) % 4 == 1, '"stated"').otherwise('"implied"')),
        ("tags", F.concat(F.lit("["), _quoted(x["role"]), F.lit(',3,"t"]'))), ("sourcePage", F.when(n(x) % 2 == 0, F.lit('"4"')).otherwise(x["turn"].cast("string"))), ("quoteVerified", F.when(n(x) % 3 == 0, "true").otherwise("null")),
    ))
    spot = lambda x: F.concat(F.lit('"s'), x["turn"].cast("string"), F.lit('":'), F.when(n(x) % 5 == 0, F.lit('"present"')).otherwise(_json(("verdict", F.when(n(x) % 3 == 0, F.lit("1")).otherwise(F.lit('"present"'))), ("reading", _quoted(x["text"])))))
    body = _json(("facts", _list(fact)), ("adjudicated", F.concat(F.lit("{"), F.array_join(F.transform("l", spot), ","), F.lit("}"))))
    return _turns(spark, sf).select("id", body.alias("body"))


@query("m17_run_facts", _MADE + """
select id, 'f' || turn fact_id, text as title, '' body, case when n % 4 = 1 then 'stated' else 'implied' end footing, role || ',t' tags, case when n % 2 = 1 then turn end source_page, n % 3 = 0 verified from t where n % 9 <> 8 and n % 4 <> 0 and n > 0""")
def m17(spark, sf):
    return versions.run_facts(_runs(spark, sf)).withColumn("tags", F.array_join("tags", ","))


@query("m18_run_verdicts", _MADE + "select id, 's' || turn spot, 'present' verdict, text as reading, '' note from t where n % 5 <> 0 and n % 3 <> 0")
def m18(spark, sf):
    return versions.run_verdicts(_runs(spark, sf))


@query("m52_introductions", _MADE + r"""
, i as (select id, sum(n)::bigint s, string_agg(trim(text), chr(10) || chr(10) order by turn) filter (n % 4 <> 0 and trim(text) <> '') p from t group by id)
select id, case when s % 6 <> 1 and p is not null then case when s % 2 = 0 then 'Introduction' else 'On ' || id end end title, case when s % 6 <> 1 then p end as text,
  case when s % 6 = 1 then 'The reply did not contain an introduction' when p is null then 'The introduction came back empty' end refused from i""")
def m52(spark, sf):
    """Replies whose paragraphs are turns, some of them numbers; some replies have none."""
    s = F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(x["text"]))
    paragraph = lambda x: F.when(F.length(x["text"]) % 4 == 0, F.lit("12")).otherwise(_quoted(F.concat(F.lit(" "), x["text"], F.lit(" "))))
    title = F.when(s % 2 == 0, F.lit('"  "')).otherwise(F.concat(F.lit('" On '), F.col("id").cast("string"), F.lit('"')))
    body = _json(("title", title), ("paragraphs", F.when(s % 6 == 1, F.lit('"none"')).otherwise(_list(paragraph))))
    return versions.introductions(_turns(spark, sf).select("id", body.alias("body")))


@query("p49_saved_looks", """
select page_id id, 'look' || page_id look_id, case when length(url) % 3 = 0 then 'Untitled look' else url end "name", '1970-01-01T00:00:00.000Z' saved_at, case when length(url) % 4 = 0 then '' else url end imprint, '' "holder", length(url) % 4 = 0 or length(url) % 5 <> 0 public_domain
from pages where length(url) % 7 <> 3""")
def p49(spark, sf):
    """Looks named by pages' addresses; missing or ill-typed fields take their defaults, one without an id is none."""
    n, url = F.length("url"), _quoted(F.col("url"))
    imprint = F.when(n % 4 == 0, F.lit('"plain"')).otherwise(_json(("imprint", url), ("copyrightHolder", "null"), ("publicDomainNotice", F.when(n % 5 == 0, "false").otherwise('"false"'))))
    look = F.when(n % 7 == 3, F.lit("8")).otherwise(F.concat(F.lit('"look'), F.col("page_id").cast("string"), F.lit('"')))
    body = _json(("id", look), ("name", F.when(n % 3 == 0, F.lit("3")).otherwise(url)), ("savedAt", "false"), ("imprint", imprint))
    return versions.saved_looks(table(spark, sf, "pages").select(F.col("page_id").alias("id"), body.alias("body")))


@query("p58_commands", """
with e as (select event_id id, event_id % 11 k, event_type t, user_id u from events)
select id, case when k = 0 then 'state' when k = 1 then 'advance' when k = 2 then 'evidence' when k in (4, 5, 6) then 'answer' end op, case when k = 2 then 'words:' || u end ref, case when k in (4, 5, 6) then 'page-' || u end question,
  case when k = 4 then '"' || t || '"' when k = 5 then '["' || t || '","b"]' when k = 6 then '{"s1":"' || t || '"}' end as value,
  case k when 3 then 'An `evidence` command needs the `ref` a snapshot gave it.' when 7 then 'An answer must be a string, a boolean, an array of strings, or an object of string to string.'
    when 8 then '“apiKey” is a credential. It is typed by the person whose credential it is, into the browser that stores it — it does not travel this channel in either direction.' when 9 then 'Unknown command “' || t || '”.' when 10 then 'A command must be an object.' end reason from e""")
def p58(spark, sf):
    """Commands off the wire, one for each event, of every kind by turns."""
    t, u = F.concat(F.lit('"'), "event_type", F.lit('"')), F.col("user_id").cast("string")
    answer = lambda question, value: _json(("op", '"answer"'), ("id", question), ("value", value))
    page = F.concat(F.lit('"page-'), u, F.lit('"'))
    kinds = [
        F.lit('{"op":"state"}'), F.lit('{"op":"advance","more":1}'), _json(("op", '"evidence"'), ("ref", F.concat(F.lit('"words:'), u, F.lit('"')))), F.lit('{"op":"evidence","ref":4}'), answer(page, t),
        answer(page, F.concat(F.lit("["), t, F.lit(',"b"]'))), answer(page, _json(("s1", t))), answer(page, F.concat(F.lit('{"s1":'), t, F.lit(',"s2":2}'))), answer(F.lit('"apiKey"'), t), _json(("op", t)), F.concat(F.lit("["), t, F.lit("]")),
    ]
    body = F.element_at(F.array(*kinds), (F.col("event_id") % 11 + 1).cast("int"))
    return versions.commands(table(spark, sf, "events").select(F.col("event_id").alias("id"), body.alias("body")))


@query("s23_edit_log", """
with e as (select event_id id, ['text', 'retype', 'drop', 'split', 'merge', 'image', 'retouch', 'section', 'note', 'anchor', 'paint'][event_id % 11 + 1] kind, event_id % 7 w, event_type t, user_id u, event_id % 13 n from events)
select id, kind, case when kind in ('text', 'retype', 'drop', 'split', 'merge') then 'b' || u else 't' || u end target,
  case when kind = 'retype' then 'heading' when kind in ('text', 'section', 'note') then t end as value, case when kind in ('split', 'note') then n end::int "at", case when kind = 'retype' and w <> 2 then 2 end::int "level",
  case when kind = 'note' then 'b' || u when kind in ('image', 'anchor') and n % 2 = 0 then 'b' || u end block_id, case when kind = 'image' then n end::int width, case when kind = 'section' then 'A title' end title, case when kind = 'retouch' then 1 end::int n_ops, case when kind = 'retouch' then n end::int x
from e where kind <> 'paint' and case kind when 'text' then w not in (1, 4) when 'retype' then w not in (1, 3) when 'drop' then w <> 1 when 'split' then w not in (1, 5) when 'merge' then w <> 1 when 'image' then w not in (0, 3, 6)
  when 'retouch' then w not in (0, 6) when 'section' then w not in (0, 3, 4) when 'note' then w not in (0, 1, 4, 5) when 'anchor' then w not in (0, 3) end""")
def s23_log(spark, sf):
    """Stored edits of all ten kinds, by turns without what their kind asks for or with it in another type."""
    e, w, n = F.col("event_id"), F.col("event_id") % 7, (F.col("event_id") % 13).cast("string")
    u = F.col("user_id").cast("string")
    kinds = F.array(*map(F.lit, ["text", "retype", "drop", "split", "merge", "image", "retouch", "section", "note", "anchor", "paint"]))
    kind = F.element_at(kinds, (e % 11 + 1).cast("int"))
    q = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    thing = F.when(w == 0, F.lit("7")).otherwise(q(F.lit("t"), u))
    after = F.when(w == 3, F.lit("4")).when(e % 13 % 2 == 0, q(F.lit("b"), u)).otherwise("null")
    placement = F.when(w == 3, '"middle"').otherwise('"front"')
    ops = F.concat(F.lit('[{"op":"crop","params":{"x":'), n, F.lit('}},{"op":"turn"},{"op":4,"params":{}},5]'))
    body = _json(
        ("kind", q(kind)), ("blockId", F.when(w == 1, F.lit('""')).otherwise(q(F.lit("b"), u))), ("text", F.when(w == 4, F.lit("3")).otherwise(q(F.col("event_type")))), ("blockKind", F.when(w == 3, '"page"').otherwise('"heading"')),
        ("level", F.when(w == 2, '"2"').otherwise("2")), ("at", F.when(w == 5, q(n)).otherwise(n)), ("imageId", thing), ("illustrationId", thing), ("sectionId", thing), ("noteId", thing), ("afterBlockId", after),
        ("sourceWidth", n), ("sourceHeight", F.when(w == 6, "null").otherwise("5")), ("placement", placement), ("title", '"A title"'), ("ops", F.when(w == 6, F.lit('[{"op":"x"}]')).otherwise(ops)),
    )
    found = versions.edit_log(table(spark, sf, "events").select(F.col("event_id").alias("id"), body.alias("body")))
    return found.select("id", "kind", "target", "value", "at", "level", "block_id", "width", "title", F.nullif(F.coalesce(F.size("ops"), F.lit(0)), F.lit(0)).alias("n_ops"), F.get("ops", F.lit(0))["x"].alias("x"))
