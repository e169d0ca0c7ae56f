"""Stored JSON, notes and names."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import markup
from ..functions import text as T
from ..functions.text import superscript
from ..operators import facts, hyphens, lines, notes, pictures, stored
from ..plans import scratch
from ..plans.views import blocks, dealt, ocr_words, shared_out, sql, table, tokens
from ..plans.views import pages as page_view
from ..sources import epub, files

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def _replies(spark, sf):
    """Each document's blocks as a reader's JSON reply; some with an unknown role, some cut short."""
    docs = table(spark, sf, "documents")
    b = blocks(docs)
    one = F.struct("bi", "kind", "text", ((F.col("bi") * 3) % 9 - 0.4).alias("level"), (F.col("bi") % 4 == 1).alias("continuesNext"))
    every = b.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("bi")).alias("blocks"))
    furniture = F.struct(F.when(F.col("doc_id") % 3 > 0, F.upper("source")).alias("runningHead"), F.when(F.col("doc_id") % 4 > 0, F.col("page_index").cast("string")).alias("folio"))
    body = F.to_json(F.struct(F.when(F.col("doc_id") % 19 == 0, "cover").otherwise(F.col("role")).alias("role"), "blocks", F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("?"))).alias("uncertain"), furniture.alias("furniture")))
    return page_view(docs).join(every, "doc_id").select("doc_id", F.when(F.col("doc_id") % 23 == 0, F.substring(body, 1, 30)).otherwise(body).alias("body"))


_REPLIES = """
, d as (select b.doc_id, p.role, p.doc_id % 19 <> 0 and p.doc_id % 23 <> 0 ok, count(*)::int n, sum(least(6, greatest(1, floor((bi * 3) % 9 - 0.4::double + 0.5))))::bigint levels, count(case when bi % 4 = 1 then 1 end)::int flags,
   string_agg(b.text, chr(10) || chr(10) order by bi) t, p.source, p.page_index from blocks b join pages_ p using (doc_id) group by b.doc_id, p.doc_id, p.role, p.source, p.page_index)
"""


@query("p07_page_reads", sql("blocks pages_", _REPLIES + """
select doc_id, ok, case when ok then role end as role, case when ok then n end n_blocks, case when ok then levels end levels, case when ok then flags end n_continued, (case when doc_id % 23 = 0 then 0 when doc_id % 6 = 0 then 1 else 0 end)::int n_uncertain from d"""))
def p07(spark, sf):
    r = stored.page_reads(_replies(spark, sf))
    levels = F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + b["level"])
    return r.select("doc_id", "ok", "role", F.size("blocks").alias("n_blocks"), levels.alias("levels"), F.size(F.filter("blocks", lambda b: b["continues_next"])).alias("n_continued"), F.size("uncertain").alias("n_uncertain"))


@query("p09_checkable_text", sql("blocks pages_", _REPLIES + """
select doc_id, t as text, concat_ws(chr(10) || chr(10), case when doc_id % 3 > 0 then nullif(trim(upper(source)), '') end, case when doc_id % 4 > 0 then page_index::varchar end, t) checkable from d where ok"""))
def p09(spark, sf):
    r = stored.page_reads(_replies(spark, sf)).where("ok")
    return r.select("doc_id", stored.page_text(F.col("blocks")).alias("text"), stored.checkable_text(F.col("blocks"), F.col("running_head"), F.col("folio")).alias("checkable"))


@query("s22_migrate_runs", """
with r as (select o_orderkey id, (3 + o_orderkey % 10)::int v, o_orderkey % 3 k, (o_orderkey % 7)::int n from orders), o as (select *, v between 5 and 10 and n > 0 ok from r)
select id, ok, case when ok then case when k = 0 then 'book' || id else 'Untitled' end end "name", case when ok then k <> 1 end complete, case when ok then n end n_pages from o""")
def s22(spark, sf):
    k = F.col("o_orderkey")
    n = (k % 7).cast("int")
    body = F.to_json(F.struct((3 + k % 10).alias("version"), F.when(k % 3 == 0, F.concat(F.lit("book"), k.cast("string"))).alias("name"), F.when(k % 3 == 1, F.lit(False)).alias("complete"), F.when(n > 0, F.sequence(F.lit(1), n)).alias("pages")))
    return stored.runs(table(spark, sf, "orders").select(k.alias("id"), body.alias("body")))


@query("s23_parse_edits", """
with e as (select event_id id, ['text', 'split', 'drop', 'paint'][event_id % 4 + 1] kind, 'b' || event_id % 11 target, event_id % 5 k from events)
select id, kind, target from e where kind <> 'paint' and k <> 4 and (kind <> 'text' or k <> 1) and (kind <> 'split' or k <> 2)""")
def s23(spark, sf):
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ["text", "split", "drop", "paint"])), (i % 4 + 1).cast("int"))
    body = F.to_json(F.struct(kind.alias("kind"), F.when(i % 5 != 4, F.concat(F.lit("b"), (i % 11).cast("string"))).alias("blockId"), F.when(i % 5 != 1, "new").alias("text"), F.when(i % 5 == 2, -1).otherwise(3).alias("at")))
    return stored.edits(table(spark, sf, "events").select(i.alias("id"), body.alias("body")))


@query("w15_corrections", """
with c as (select doc_id block_id, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then reverse(text) end as text from documents)
select block_id, c.text from c left join documents d on d.doc_id = c.block_id and d.doc_id % 5 > 0 where c.text is distinct from d.text""")
def w15(spark, sf):
    docs = table(spark, sf, "documents")
    edited = docs.select(F.col("doc_id").alias("block_id"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.reverse("text")).alias("text"))
    return stored.corrections(edited, docs.where("doc_id % 5 > 0").select(F.col("doc_id").alias("block_id"), F.col("text").alias("pristine")))


@query("w03_orphan_notes", sql("blocks", r"""
, n as (select doc_id, (doc_id * 7 + bi) % 40 || '' marker from blocks where kind = 'footnote'), b as (select doc_id, string_agg(text, ' ' order by bi) body from blocks where kind <> 'footnote' group by 1)
select n.doc_id, marker from n left join b using (doc_id) where not coalesce(regexp_matches(body, '(^|[^0-9])' || marker || '([^0-9]|$)') or contains(body, translate(marker, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')), false)"""))
def w03(spark, sf):
    b = blocks(table(spark, sf, "documents"))
    notes = b.where("kind = 'footnote'").select("doc_id", ((F.col("doc_id") * 7 + F.col("bi")) % 40).cast("string").alias("marker"))
    body = b.where("kind <> 'footnote'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("bi", "text"))).alias("l"))
    return stored.orphan_notes(notes, body.select("doc_id", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("body")))


@query("s13_choose_creator", """
with c as (select conv_id book, turn pos, case when turn % 3 = 1 then 'aut' when turn % 3 = 2 then 'edt' end as role, text[1:12] "name" from conversations where conv_id % 2 = 0 or turn % 3 <> 1)
select book, arg_min("name", (case when role = 'aut' then 0 when role is null then 1 else 2 end, pos)) "name" from c group by 1""")
def s13(spark, sf):
    role = F.when(F.col("turn") % 3 == 1, "aut").when(F.col("turn") % 3 == 2, "edt")
    rows = table(spark, sf, "conversations").where("conv_id % 2 = 0 or turn % 3 <> 1")
    return stored.choose_creator(rows.select(F.col("conv_id").alias("book"), F.col("turn").alias("pos"), role.alias("role"), F.substring("text", 1, 12).alias("name")))


@query("a20_paper_tone", sql("tok ocr", "select doc_id, list(confidence order by confidence)[floor(count(*) * 0.9)::int + 1] tone from ocr group by 1"))
def a20(spark, sf):
    return stored.order_statistic(ocr_words(tokens(table(spark, sf, "documents"))), "doc_id", "confidence")


@query("a25_distinct_kinds", sql("blocks", "select doc_id, list_sort(list(distinct kind)) kinds from blocks group by 1"))
def a25(spark, sf):
    return blocks(table(spark, sf, "documents")).groupBy("doc_id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


@query("s12_first_year", r"select page_id, nullif(regexp_extract(html, '\b(1[0-9]{3}|20[0-9]{2})\b', 1), '') as year from pages")
def s12(spark, sf):
    year = F.regexp_extract("html", r"\b(1\d{3}|20\d{2})\b", 1)
    return table(spark, sf, "pages").select("page_id", F.nullif(year, F.lit("")).alias("year"))


@query("m23_book_file_names", r"""
select page_id, rtrim(ltrim(regexp_replace(lower(trim(regexp_replace(f, '(?i)\.(pdf|epub)$', ''))), '[^\p{L}\p{N}]+', '-', 'g'), '-'), '-')[1:60] || '.book.json' "file" from (select page_id, url || case page_id % 3 when 0 then '.PDF' when 1 then '.epub' else '' end f from pages)""")
def m23(spark, sf):
    ending = F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".epub").otherwise("")
    return table(spark, sf, "pages").select("page_id", T.file_name(F.concat("url", ending)).alias("file"))


@query("m32_words_refs", """
select doc_id, page_index, 'words:' || page_index || ':' || string_agg('p' || page_index || '_w' || word_no, ',' order by word_no) ref, count(*)::int n from (
select doc_id, ((pos - 1) // 250)::bigint page_index, (pos - 1) % 250 word_no from (select doc_id, unnest(range(1, len(l) + 1)) pos from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') l from documents))) where word_no % 50 = 7 group by 1, 2""")
def m32(spark, sf):
    """References to a page's marked words, written and read back."""
    words = ocr_words(tokens(table(spark, sf, "documents"))).where("word_no % 50 = 7")
    name = F.concat(F.lit("p"), F.col("page_index").cast("string"), F.lit("_w"), F.col("word_no").cast("string"))
    grouped = words.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("word_no", name.alias("id")))).alias("w"))
    ref = F.concat(F.lit("words:"), F.col("page_index").cast("string"), F.lit(":"), F.array_join(F.transform("w", lambda x: x["id"]), ","))
    ids = F.filter(F.split(F.regexp_extract("ref", r"^words:(\d+):(.*)$", 2), ","), lambda x: F.trim(x) != "")
    return grouped.withColumn("ref", ref).select("doc_id", F.regexp_extract("ref", r"^words:(\d+):", 1).cast("long").alias("page_index"), "ref", F.size(ids).alias("n"))


def _corrected(wrong: str, right: str, of: str) -> str:
    """Whole words put right, each behind a mark; twice, as neighbours share the sign between them."""
    for _ in range(2):
        of = rf"regexp_replace({of}, '(^|[^\p{{L}}\p{{N}}_-]){wrong}($|[^\p{{L}}\p{{N}}_-])', '\1' || chr(1) || '{right}\2', 'g')"
    return of


_CORRECTED = "coalesce(text, '')"
for _wrong, _right in (("thand", "than"), ("Thand", "Than"), ("die", "dye"), ("Die", "Dye")):
    _CORRECTED = _corrected(_wrong, _right, _CORRECTED)


@query("t13_term_corrections", f"""
select doc_id, sha256(replace(t, chr(1), '')) text_sha256, (length(t) - length(replace(t, chr(1), '')))::int replaced from (select doc_id, {_CORRECTED} t from documents)""")
def t13(spark, sf):
    """Two misreadings put right in every document, whole words only, with the number of changes."""
    return table(spark, sf, "documents").select("doc_id", markup.corrected(F.col("text")).alias("c")).select("doc_id", F.sha2("c.text", 256).alias("text_sha256"), "c.replaced")


@query("w19_prepared_notes")
def w19(spark, sf):
    """Each document's notes put where their markers first stand; some have a place of their own instead."""
    b = blocks(table(spark, sf, "documents"))
    found = b.where("kind = 'footnote'")
    own = F.col("bi") % 3 == 0
    asked = found.select(
        "doc_id", F.concat(F.lit("fn"), F.col("bi").cast("string")).alias("note_id"), F.element_at(F.split("text", r"\s+"), 1).alias("marker"),
        F.when(own, F.col("bi") - 1).alias("home"), F.when(own, F.lit(12)).alias("at"),
    )
    return notes.prepare(b.where("kind <> 'footnote'").select("doc_id", "bi", "text"), asked)


@query("t07_stripped_markers", sql("blocks", r"""
, n as (select doc_id, bi, (bi % 30 + 1)::varchar m, text from blocks), raised as (select *, translate(m, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') r from n)
select doc_id, bi, text as bare, text as raised, case when text = '' then m || '.' else m || text end glued from raised"""))
def t07(spark, sf):
    """Every block as a note that begins with its number, plain and raised, and with a number that isn't its marker."""
    marker = (F.col("bi") % 30 + 1).cast("string")
    rows = blocks(table(spark, sf, "documents")).withColumn("m", marker)
    strip = lambda t: notes.strip_marker(t, F.col("m"))
    return rows.select(
        "doc_id", "bi", strip(F.concat("m", F.lit(") "), "text")).alias("bare"), strip(F.concat(superscript(F.col("m")), F.lit(" "), F.col("text"))).alias("raised"),
        notes.strip_marker(F.concat("m", "text"), F.lit("999")).alias("glued"),
    )


#: Patterns by rule: a break between vowel and consonant, none inside what is one sound or before a last consonant.
_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"
PATTERNS = [f"{v}1{c}" for v in _VOWELS for c in _CONSONANTS] + [f"{c}2h" for c in "cgpstw"] + [f"2{c}." for c in _CONSONANTS] + [f".{v}2" for v in _VOWELS] + ["n1d", "n2dr", "1tion", "ti4on"]


@query("x03_hyphenated_words", sql("tok", r"""
, p(pattern) as (values """ + ", ".join(f"('{p}')" for p in PATTERNS) + r""")
, pat as (select regexp_replace(pattern, '[0-9]', '', 'g') letters, list_transform(regexp_extract_all(pattern || '$', '([0-9]?)([^0-9])', 1), lambda x: case when x = '' then 0 else x::int end) digits from p)
, w as (select distinct lower(regexp_replace(token, '[^\p{L}]', '', 'g')) word from tok), d as (select word, '.' || word || '.' t from w)
, s as (select word, i, substr(t, i, n) letters from (select *, unnest(range(1, length(t) + 1)) i from d), (values (1), (2), (3), (4), (5)) v(n) where i + n - 1 <= length(t))
, g as (select word, i + k - 2 "at", max(digit) digit from (select word, i, unnest(range(0, len(digits))) k, unnest(digits) digit from s join pat using (letters)) where digit > 0 group by 1, 2)
, b as (select word, list("at" order by "at") a from g where digit % 2 = 1 and "at" >= 2 and length(word) - "at" >= 3 group by word)
select word, coalesce(array_to_string(list_transform(range(0, len(a) + 1), lambda k: substr(word, case when k = 0 then 1 else a[k] + 1 end, case when k = len(a) then 999 else a[k + 1] - case when k = 0 then 0 else a[k] end end)), '-'), word) parts
from w left join b using (word)"""))
def x03(spark, sf):
    """The documents' different words, broken at the places that a table of patterns allows."""
    word = F.lower(F.regexp_replace("token", r"[^\p{L}]", ""))
    words = tokens(table(spark, sf, "documents")).select(word.alias("word"))
    broken = hyphens.breaks(words, spark.createDataFrame([(p,) for p in PATTERNS], "pattern string"))
    return hyphens.parts(broken).select("word", F.array_join("parts", "-").alias("parts"))


@query("w20_hyphenated_lines")
def w20_hyphenated(spark, sf):
    """Each paragraph broken into narrow lines, also inside words where the patterns allow it."""
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    return lines.break_hyphenated(blocks(dealt(table(spark, sf, "documents"))).where("kind = 'paragraph'"), patterns, 160.0)


@query("j14_illustrations")
def j14(spark, sf):
    """The large blank parts of pages, suppressed, joined and cut to the three largest of a page."""
    words = ocr_words(tokens(table(spark, sf, "documents"))).where("page_index % 2 = 0 or y0 % 400 >= 200")
    return pictures.illustrations(pictures.blank_regions(words, 1100, 1200, 0.05), 55)


def _archives(spark, sf):
    """name, content of archives of four web pages each, the first of an archive's addresses as its title and an image of its own."""
    rows = table(spark, sf, "pages").select(F.floor(F.col("page_id") / 4).cast("long").alias("book"), "page_id", "url", "html")
    # Few archives a task, so that Python holds as much of them however many there are.
    group = shared_out(rows, "book", "html").groupBy("book").agg(F.array_sort(F.collect_list(F.struct("page_id", "url", "html"))).alias("l"))

    def bind(frames):
        import pandas as pd
        from html import escape

        for frame in frames:
            out = []
            for book, l in zip(frame["book"], frame["l"]):
                content = epub.write([(f"p{x['page_id']}.xhtml", x["html"] or "") for x in l], escape(l[0]["url"] or ""), {"cover.png": f"cover {book}".encode()})
                out.append((f"book{book}.epub", content))
            yield pd.DataFrame(out, columns=["name", "content"])

    return group.mapInPandas(bind, "name string, content binary")


def _bound(spark, sf):
    """What a folder of these archives holds."""
    files.register(spark)
    path = f"{scratch.shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    _archives(spark, sf).write.format("leafmill_files").mode("append").save(path)
    return epub.entries(spark, path)


@query("s09_epub_pages")
def s09(spark, sf):
    """Web pages bound into archives of a few each, written, opened again and walked."""
    return epub.pages(_bound(spark, sf))


@query("s10_archive_entries", """
with p as (select *, page_id // 4 book from pages), b as (select book, arg_min(url, page_id) url from p group by 1)
select 'book' || book || '.epub' archive, 'page' kind, (page_id % 4)::int page, 'OPS/text/p' || page_id || '.xhtml' "name", case when coalesce(html, '') <> '' then sha256(html) end content_sha256,
  case when coalesce(html, '') = '' then 'the archive has no such file' end reason from p
union all select 'book' || book || '.epub', 'image', null, 'OPS/img/cover.png', sha256('cover ' || book), null from b
union all select 'book' || book || '.epub', 'metadata', null, 'title', sha256(regexp_replace(trim(url), '\\s+', ' ', 'g')), null from b where trim(coalesce(url, '')) <> ''""")
def s10(spark, sf):
    """All that the archives hold: metadata, pages in reading order, images."""
    found = _bound(spark, sf)
    return found.select("archive", "kind", "page", "name", F.sha2("content", 256).alias("content_sha256"), "reason")


@query("s12_archive_titles", """
select 'book' || (page_id // 4) || '.epub' archive, nullif(regexp_replace(trim(arg_min(url, page_id)), '\\s+', ' ', 'g'), '') title from pages group by 1, page_id // 4""")
def s12_titles(spark, sf):
    return epub.metadata(_bound(spark, sf)).select("archive", "title")


@query("k05_written_book_files", """
select 'books/' || conv_id || '.book.json' "name", sha256('{"format":"book-file","version":3,"title":"' || conv_id || '","edits":[' || array_to_string(list_transform(range(0, count(*)), lambda x: '{"kind":"text"}'), ',') || '],"images":[]}') content_sha256
from conversations group by conv_id""")
def k05(spark, sf):
    """A file for each conversation as a book, written all or none, and read back as text."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.collect_list(F.lit(1)), lambda x: F.struct(F.lit("text").alias("kind"))).alias("e"))
    none = F.array().cast("array<struct<name:string,path:string,bytes:binary>>")
    name = F.concat(F.lit("books/"), F.col("conv_id").cast("string"), F.lit(".book.json"))
    body = stored.book_file(F.col("conv_id").cast("string"), F.col("e"), none)
    files.register(spark)
    path = f"{scratch.shared_folder(spark)}/books-{uuid.uuid4().hex}"
    rows.select(name.alias("name"), F.encode(body, "UTF-8").alias("content")).write.format("leafmill_files").mode("append").save(path)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return back.select(F.concat(F.lit("books/"), F.element_at(F.split("path", "/"), -1)).alias("name"), F.sha2("content", 256).alias("content_sha256"))


@query("k04_bank_files", """
with f as (select event_type category, '- e' || event_id || ' (' || case when event_id % 2 = 0 then 'stated' else 'context' end || ')' line, event_id from events)
select category || '.md' "name", sha256('# ' || category || chr(10) || chr(10) || string_agg(line, chr(10) order by event_id) || chr(10)) content_sha256 from f group by category""")
def k04(spark, sf):
    """A bank of facts written as a file a category, and read back."""
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("fact_id"), F.col("event_type").alias("category"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("title"), F.when(F.col("event_id") % 2 == 0, "stated").otherwise("context").alias("footing")
    )
    files.register(spark)
    path = f"{scratch.shared_folder(spark)}/bank-{uuid.uuid4().hex}"
    facts.bank_files(rows).write.format("leafmill_files").mode("append").save(path)
    back = spark.read.format("binaryFile").load(path)
    return back.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("content_sha256"))


@query("s05_flatten_words", sql("tok ocr", "select doc_id, page_index, row_number() over (partition by doc_id, page_index order by pos) - 1 n, text from ocr where word_no % 9 <> 4"))
def s05(spark, sf):
    """Words nested by page and line, blank ones among them, flattened and numbered again."""
    words = ocr_words(tokens(dealt(table(spark, sf, "documents"))))
    text = F.when(F.col("word_no") % 9 == 4, " ").otherwise(F.col("text"))
    line = words.groupBy("doc_id", "page_index", "y0").agg(F.array_sort(F.collect_list(F.struct("pos", text.alias("text")))).alias("words"))
    page = line.groupBy("doc_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("y0", "words"))).alias("lines"))
    flat = F.filter(F.flatten(F.transform("lines", lambda x: x["words"])), lambda w: F.trim(w["text"]) != "")
    return page.select("doc_id", "page_index", F.posexplode(flat).alias("n", "w")).select("doc_id", "page_index", F.col("n").cast("long").alias("n"), "w.text")


@query("x01_fixed_widths", sql("blocks", "select doc_id, bi, round(length(text) * 11 * 0.5, 6) width from blocks"))
def x01(spark, sf):
    return blocks(table(spark, sf, "documents")).select("doc_id", "bi", F.round(F.length("text") * 11 * 0.5, 6).alias("width"))


@query("s21_book_files", """
with c as (select conv_id id, list(text order by turn) t, count(*)::int n from conversations group by 1)
select id, case when id % 7 = 3 then 'another format' when id % 7 = 5 then 'a newer version' when id % 7 = 6 then 'not json' end refused, case when id % 7 not in (3, 5, 6) then t[1][1:20] end title,
 case when id % 7 not in (3, 5, 6) then n end n_edits, case when id % 7 not in (3, 5, 6) then list_sum(list_transform(t, lambda x, i: case when (i - 1) % 2 = 0 then strlen(x) else 0 end))::int end "inline", case when id % 7 not in (3, 5, 6) then (n // 2)::int end by_path from c""")
def s21(spark, sf):
    """Conversations as books: turns as edits and, by turns, as images held or pointed to; written and read back."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    edits = F.transform("t", lambda x: F.struct(F.lit("text").alias("kind")))
    images = F.transform("t", lambda x, i: F.struct(i.cast("string").alias("name"), F.when(i % 2 == 1, F.lit("p")).alias("path"), F.encode(x, "UTF-8").alias("bytes")))
    body = stored.book_file(F.substring(F.get("t", 0), 1, 20), edits, images)
    turn = F.col("conv_id") % 7
    body = F.when(turn == 3, F.replace(body, F.lit('"book-file"'), F.lit('"other"'))).when(turn == 5, F.replace(body, F.lit('"version":3'), F.lit('"version":9'))).when(turn == 6, F.substring(body, 1, 8)).otherwise(body)
    return stored.read_book_files(rows.select(F.col("conv_id").alias("id"), body.alias("body")))


@query("w28_known_spots", """
with s as (select event_id, case when event_id % 4 = 0 then 'p' || event_id || 'd1' else 's' || event_id end spot_id, ['present', 'maybe', 'unclear'][event_id % 3 + 1] verdict from events)
select spot_id, verdict from s where verdict <> 'maybe' and event_id % 4 > 0""")
def w28(spark, sf):
    i = F.col("event_id")
    spot = F.when(i % 4 == 0, F.concat(F.lit("p"), i.cast("string"), F.lit("d1"))).otherwise(F.concat(F.lit("s"), i.cast("string")))
    said = F.element_at(F.array(*map(F.lit, ["present", "maybe", "unclear"])), (i % 3 + 1).cast("int"))
    return stored.known_spots(table(spark, sf, "events").select(spot.alias("spot_id"), said.alias("verdict")))
