"""Books bound from pages: documents as pages, with pictures, flags and pages left out by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import binding
from ..plans.views import blocks, pages, sql, table

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def _book(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sorted pages, blocks, pictures); every ninth page is left out by choice."""
    docs = table(spark, sf, "documents")
    view = pages(docs)
    sorted_ = binding.sorted_pages(view, view.where(F.col("doc_id") % 9 == 4))
    d, b = F.col("doc_id"), F.col("bi")
    rows = blocks(docs).join(view.select("doc_id", "book", "page_index"), "doc_id")
    rows = rows.select(
        "book", "page_index", "bi", "kind", "text", (1 + b % 3).cast("int").alias("level"), ((d + b) % 6 == 0).alias("continues_next"), ((d + b) % 8 == 1).alias("continues_previous"),
        F.when(F.length("text") % 2 == 0, F.element_at(F.split("text", r"\s+"), 1)).alias("marker"),
    )
    some = F.when(d % 7 == 0, 2).when(d % 5 == 0, 1).otherwise(0)
    pictures = view.select("book", "page_index", "doc_id", F.explode(F.sequence(F.lit(0), some)).alias("n")).where("n > 0")
    return sorted_, rows, pictures.select("book", "page_index", "n", F.concat(F.lit("i"), F.col("doc_id").cast("string"), F.lit("_"), F.col("n").cast("string")).alias("picture_id"))


_BOUND = r"""
, pg as (select *, doc_id % 9 = 4 left_out, role in ('half-title', 'title-page', 'copyright') mined, role in ('table-of-contents', 'list-of-illustrations', 'index', 'blank') remade from pages_)
, pages2 as (select doc_id, book, page_index, role, case when left_out then 'you chose to leave this page out' when mined then 'Used for book details; replaced by your own front matter.' when remade then 'Regenerated for this edition, or blank.' end reason,
  case when role in ('dedication', 'epigraph', 'colophon') then 'aside' else 'body' end target, coalesce(sum(left_out::int) over (partition by book order by page_index rows between unbounded preceding and 1 preceding), 0) gaps from pg)
, kept as (select b.*, book, page_index, target, gaps, 1 + bi % 3 "level", (doc_id + bi) % 6 = 0 cn, (doc_id + bi) % 8 = 1 cp, case when doc_id % 7 = 0 then 2 when doc_id % 5 = 0 then 1 else 0 end n_pictures
  from blocks b join pages2 using (doc_id) where reason is null)
, ranked as (select *, case when kind = 'caption' then row_number() over (partition by doc_id, kind order by bi) end k from kept)
, flow as (select *, gaps > lag(gaps) over (partition by book order by page_index, bi) parted, gaps > lag(gaps) over w apart, lag(kind) over w pk, lag(text) over w pt, lag(cn) over w pcn from ranked
  where kind <> 'footnote' and not coalesce(k <= n_pictures, false) window w as (partition by book, target order by page_index, bi))
, joined as (select *, coalesce(pk = kind and kind in ('paragraph', 'verse') and not coalesce(parted, false) and ((coalesce(pcn, false) and not (target = 'body' and coalesce(apart, false))) or cp
  or (trim(pt) <> '' and (not regexp_matches(rtrim(pt), '[.!?:;"'')\]]$') or regexp_matches(rtrim(pt), '-$')) and regexp_matches(ltrim(text), '^\p{Ll}'))), false) joins from flow)
, isl as (select *, sum((not joins)::int) over (partition by book, target order by page_index, bi) island from joined)
, glue as (select *, lead(island) over (partition by book, target order by page_index, bi) = island goes_on from isl)
, bound as (select book, target, island - 1 place, 'p' || arg_min(page_index, (page_index, bi)) || 'b' || arg_min(bi, (page_index, bi)) id, arg_min(kind, (page_index, bi)) kind, arg_min("level", (page_index, bi)) "level", count(*) n, list_sort(list_distinct(list(page_index))) pages,
  replace(string_agg(case when coalesce(goes_on, false) and regexp_matches(rtrim(t), '\p{L}[-\x{AD}]$') then regexp_replace(rtrim(t), '[-\x{AD}]$', '') when coalesce(goes_on, false) then rtrim(t) || ' ' else t end, '' order by page_index, bi), chr(173), '') as text
  from (select *, case when joins then ltrim(text) else text end t from glue) group by book, target, island)
"""


@query("w02_bound_books", sql("blocks pages_", _BOUND + """select book, target, place::bigint place, id, kind, case when kind = 'heading' then "level" end "level", text, n::int n, pages from bound"""))
def w02(spark, sf):
    """The flow of each book: blocks joined across pages, captions taken by pictures, pages left out."""
    return binding.bound(*_book(spark, sf))


@query("w02_skipped_pages", sql("blocks pages_", _BOUND + "select book, page_index, role, reason from pages2 where reason is not null"))
def w02_skipped(spark, sf):
    return binding.skipped(_book(spark, sf)[0])


@query("w02_captioned_pictures", sql("blocks pages_", _BOUND + """
, pic as (select book, page_index, doc_id, n, 'i' || doc_id || '_' || n picture_id from pages2, (values (1), (2)) v(n) where reason is null and n <= case when doc_id % 7 = 0 then 2 when doc_id % 5 = 0 then 1 else 0 end)
select p.book, p.page_index, picture_id, replace(trim(text), chr(173), '') "caption" from pic p left join ranked r on r.doc_id = p.doc_id and r.k = p.n"""))
def w02_captions(spark, sf):
    return binding.captioned(*_book(spark, sf))


@query("w02_book_notes", sql("blocks pages_", _BOUND + r"""
, f as (select *, coalesce(case when length(text) % 2 = 0 then string_split_regex(text, '\s+')[1] end, '*') m, 'fn' || row_number() over (partition by book order by page_index, bi) note_id from kept where kind = 'footnote')
, body as (select book, text from bound where target = 'body')
select book, note_id, page_index, m marker, case when starts_with(t, m) and regexp_matches(t[length(m) + 1:], '^([.)\]:]\s*|\s+)\S') then regexp_replace(t[length(m) + 1:], '^([.)\]:]\s*|\s+)', '') else t end as text,
  not exists (select 1 from body where body.book = f.book and case when regexp_matches(m, '^[0-9]+$') then regexp_matches(body.text, '(^|[^0-9])' || m || '([^0-9]|$)') else contains(body.text, m) end) orphaned
from (select *, replace(trim(text), chr(173), '') t from f) f"""))
def w02_notes(spark, sf):
    """The notes of each book, numbered through, without their markers, and whether the body has these."""
    sorted_, rows, pictures = _book(spark, sf)
    return binding.book_notes(sorted_, rows, binding.bound(sorted_, rows, pictures))


@query("w02_contents", sql("blocks pages_", _BOUND + """select book, id, trim(text) title, "level", place::bigint place, pages[1] page from bound where target = 'body' and kind = 'heading'"""))
def w02_contents(spark, sf):
    return binding.contents(binding.bound(*_book(spark, sf)))
