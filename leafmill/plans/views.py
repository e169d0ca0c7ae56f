"""Views that give the given tables the shapes that the operators work on.

A book is a run of ``BOOK`` consecutive document ids and a page one of its documents, so that no book, and so no
window or group over one, grows with the collection. Where pages of words are meant, a page is ``WORDS_PER_PAGE``
words of one document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK, WORDS_PER_PAGE = 50, 250

#: White space as web text has it: more than the ASCII blanks that a regular expression's \s stands for.
BLANK = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"

#: The roles that a page can have, in order.
ROLES = [
    "half-title", "title-page", "copyright", "dedication", "epigraph", "preface", "table-of-contents",
    "list-of-illustrations", "chapter-opening", "body", "part-divider", "plate", "index", "appendix", "glossary",
    "colophon", "blank", "unknown",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that one task is dealt.
SHARE = 8 << 20


def dealt(docs: DataFrame) -> DataFrame:
    """doc_id, text: all rows of a document in one task, in as many tasks as leave each about ``SHARE`` bytes of text.

    Counts, windows and groups by document (or by document and more) then need no shuffle of words, which are several times
    the text, and what a task holds stays the same however much text there is.
    """
    return shared_out(docs.select("doc_id", "text"), "doc_id", "text")


def shared_out(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``rows`` with all of a key in one task, in as many tasks as leave each about ``SHARE`` bytes of ``text``."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, size // SHARE + 1), key)


def book_of(doc_id):
    return F.floor(doc_id / BOOK).cast("long")


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 1), token."""
    words = F.filter(F.split("text", BLANK + "+"), lambda x: x != "")
    return docs.select("doc_id", F.posexplode(words).alias("p", "token")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), "token")


def _scanned(doc_id, at, token) -> dict:
    """What a scanner says of the word with ``at`` others before it: its page, a place in it, a confidence and a box."""
    on_page = at % WORDS_PER_PAGE
    x0, y0 = 100 + (at % 10) * 90, 120 + F.floor(on_page / 10) * 40
    return {
        "page_index": F.floor(at / WORDS_PER_PAGE).cast("long"), "word_no": on_page, "text": token, "confidence": 40 + (doc_id * 31 + (at + 1) * 17) % 61,
        "x0": x0, "y0": y0, "x1": x0 + F.least(F.lit(80), 8 * F.length(token)), "y1": y0 + 30,
    }


def ocr_words(tok: DataFrame) -> DataFrame:
    """Words as a scanner reads them: a page, a place in it, a confidence from 40 to 100 and a box on a grid."""
    said = _scanned(F.col("doc_id"), F.col("pos") - 1, F.col("token"))
    return tok.select("doc_id", *(c.alias(n) for n, c in said.items()), "pos")


def ocr_pages(docs: DataFrame) -> DataFrame:
    """doc_id, pages: the words of ``ocr_words`` as an array of pages of words."""
    words = F.filter(F.split("text", BLANK + "+"), lambda x: x != "")
    docs = docs.select("doc_id", words.alias("l"))

    def page(p):
        first = p * WORDS_PER_PAGE
        said = lambda w, k: F.struct(*(c.alias(n) for n, c in _scanned(F.col("doc_id"), first + k, w).items()))
        return F.transform(F.slice("l", (first + 1).cast("int"), WORDS_PER_PAGE), said)

    last = F.floor((F.size("l") - 1) / WORDS_PER_PAGE).cast("long")
    # No condition on their number: Spark would look for words in all texts before they are dealt out.
    numbers = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))), lambda p: p <= last)
    return docs.select("doc_id", F.transform(numbers, page).alias("pages"))


def second_reading(tok: DataFrame) -> DataFrame:
    """The tokens without the first eight words of some stretches of forty."""
    cell = F.floor((F.col("pos") - 1) / 40)
    return tok.where(~((cell % 7 == 3) & ((F.col("pos") - 1) % 40 < 8)))


def _halves(text, confidence, pos, **more):
    """``more``, pos, text, confidence of the word at ``pos`` (from 1), or of its two halves."""
    mid = (F.length(text) / 2).cast("int")
    cut = ((pos - 1) % 10 == 9) & text.rlike(r"^\p{L}{6,}$")
    hyphen = F.when(pos % 20 == 0, "-").otherwise("\xad")
    part = lambda k, t, c: F.struct(*(v.alias(n) for n, v in more.items()), (2 * pos + k).alias("pos"), t.alias("text"), c.alias("confidence"))
    both = F.array(part(0, F.concat(F.left(text, mid), hyphen), confidence), part(1, F.substring(text, mid + 1, F.length(text)), 40 + confidence * 7 % 61))
    return F.when(cut, both).otherwise(F.array(part(0, text, confidence)))


def cut_words(ocr: DataFrame) -> DataFrame:
    """``ocr`` as a scanner gives it at line ends: every tenth word of six letters or more comes as two halves, the first with a
    hyphen, by turns a soft one. doc_id, page_index, pos, text, confidence, id."""
    rows = ocr.select("doc_id", "page_index", F.explode(_halves(F.col("text"), F.col("confidence"), F.col("pos"))).alias("x"))
    return rows.select("doc_id", "page_index", "x.*", F.concat(F.lit("w"), F.col("x.pos").cast("string")).alias("id"))


def word_lists(docs: DataFrame) -> DataFrame:
    """doc_id, own: the words of ``tokens`` as an array; other: those of ``second_reading``."""
    rows = docs.select("doc_id", F.array_remove(F.split("text", BLANK + "+"), "").alias("own"))
    return rows.select("doc_id", "own", F.filter("own", lambda _, k: ~((F.floor(k / 40) % 7 == 3) & (k % 40 < 8))).alias("other"))


def place_lists(docs: DataFrame) -> DataFrame:
    """doc_id, own: the places (from 1) of the words of ``tokens`` as an array; other: the places there of those of ``second_reading``."""
    n = F.size(F.array_remove(F.split("text", BLANK + "+"), ""))
    rows = docs.where("text is not null").select("doc_id", n.alias("n"))
    rows = rows.select("doc_id", F.when(F.col("n") > 0, F.sequence(F.lit(1), "n")).otherwise(F.array().cast("array<int>")).alias("own"))
    return rows.select("doc_id", "own", F.filter("own", lambda p: ~((F.floor((p - 1) / 40) % 7 == 3) & ((p - 1) % 40 < 8))).alias("other"))


def scanned_confidence(doc_id, pos):
    """The confidence of ``ocr_words`` by doc_id and place (arrays of numpy)."""
    return 40 + np.fmod(doc_id * 31 + pos * 17, 61)


def cut_lists(lists: DataFrame) -> DataFrame:
    """``word_lists`` with scan: the words of ``cut_words`` as an array of page_index, pos, text, confidence."""

    def said(token, k):
        k = k.cast("long")
        word = _scanned(F.col("doc_id"), k, token)
        return _halves(token, word["confidence"], k + 1, page_index=word["page_index"])

    return lists.withColumn("scan", F.flatten(F.transform("own", said)))


def transcriptions(tok: DataFrame) -> DataFrame:
    """doc_id, page_index, role, text, orphan_notes: pages as another reader gave them, by turns whole, empty, cut, doubled or
    with other words in the place of some."""
    page = F.floor((F.col("pos") - 1) / WORDS_PER_PAGE).cast("long")
    rows = tok.select("doc_id", page.alias("page_index"), "pos", "token").withColumn("turn", (F.col("doc_id") * 7 + F.col("page_index")) % 9)
    turn, pos = F.col("turn"), F.col("pos")
    gone = (turn == 0) | ((turn == 1) & (pos % 2 == 0)) | ((turn == 3) & (pos % 5 == 0)) | ((turn > 4) & (pos % 97 == 0))
    word = F.when((turn == 4) & (pos % 3 == 0), "blur").when(turn == 2, F.concat_ws(" ", "token", "token")).otherwise(F.col("token"))
    words = F.transform(F.array_sort(F.collect_list(F.when(~gone, F.struct("pos", word.alias("w"))))), lambda x: x["w"])
    role = F.element_at(F.array(*map(F.lit, ROLES)), ((F.col("doc_id") + F.col("page_index")) % len(ROLES) + 1).cast("int"))
    notes = ((F.col("doc_id") + F.col("page_index")) % 5 == 0).cast("int")
    return rows.groupBy("doc_id", "page_index").agg(F.array_join(words, " ").alias("text")).select("doc_id", "page_index", role.alias("role"), "text", notes.alias("orphan_notes"))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, bi (from 0), kind, text: a document's lines that aren't blank."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    turn = (F.col("doc_id") + F.col("bi")) % 11
    kind = (
        F.when(F.col("bi") == 0, "heading").when(turn == 3, "footnote").when(turn == 5, "caption").when(turn == 7, "table").otherwise("paragraph")
    )
    return docs.select("doc_id", F.posexplode(lines).alias("p", "line")).select("doc_id", F.col("p").cast("long").alias("bi"), F.trim("line").alias("text")).select(
        "doc_id", "bi", kind.alias("kind"), "text"
    )


def pages(docs: DataFrame) -> DataFrame:
    """book, page_index, doc_id, role, text, lang, source; a role by turns."""
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("doc_id") % len(ROLES) + 1).cast("int"))
    return docs.select(book_of(F.col("doc_id")).alias("book"), (F.col("doc_id") % BOOK).alias("page_index"), "doc_id", role.alias("role"), "text", "lang", "source")


_ROLES_SQL = "[" + ", ".join(f"'{r}'" for r in ROLES) + "]"

#: The same views in the oracle's SQL; a query takes those that it names.
SQL = {
    "tok": "tok as (select doc_id, unnest(range(1, len(l) + 1)) pos, unnest(l) as token from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') l from documents))",
    "ocr": """ocr as (select doc_id, ((pos - 1) // 250)::bigint page_index, (pos - 1) % 250 word_no, token as text, 40 + (doc_id * 31 + pos * 17) % 61 confidence,
       100 + ((pos - 1) % 10) * 90 x0, 120 + (((pos - 1) % 250) // 10) * 40 y0, 100 + ((pos - 1) % 10) * 90 + least(80, 8 * length(token)) x1,
       150 + (((pos - 1) % 250) // 10) * 40 y1, pos from tok)""",
    "rd": "rd as (select doc_id, pos, token from tok where not (((pos - 1) // 40) % 7 = 3 and (pos - 1) % 40 < 8))",
    "blocks": """blocks as (select doc_id, bi, case when bi = 0 then 'heading' when (doc_id + bi) % 11 = 3 then 'footnote' when (doc_id + bi) % 11 = 5 then 'caption'
       when (doc_id + bi) % 11 = 7 then 'table' else 'paragraph' end kind, trim(line) as text
       from (select doc_id, unnest(range(0, len(l))) bi, unnest(l) line from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') l from documents)))""",
    "cut": r"""cut as (select doc_id, page_index, 2 * pos + k as pos, case when not c then text when k = 0 then left(text, length(text) // 2) || case when pos % 20 = 0 then '-' else chr(173) end
       else substr(text, length(text) // 2 + 1) end as text, case when k = 0 then confidence else 40 + confidence * 7 % 61 end confidence, 'w' || (2 * pos + k) id
       from (select *, (pos - 1) % 10 = 9 and regexp_matches(text, '^\p{L}{6,}$') c from ocr), (values (0), (1)) t(k) where k = 0 or c)""",
    "healed": r"""halves as (select *, regexp_matches(text, '\p{L}[-\x{AD}]$') and coalesce(regexp_matches(lead(text) over w, '^\p{L}'), false) half from cut window w as (partition by doc_id, page_index order by pos)),
       islands as (select *, sum(case when coalesce(lag, false) then 0 else 1 end) over (partition by doc_id, page_index order by pos) isl from (select *, lag(half) over (partition by doc_id, page_index order by pos) lag from halves)),
       healed as (select doc_id, page_index, min(pos) as pos, string_agg(case when half then left(text, length(text) - 1) else text end, '' order by pos) as text, min(confidence) confidence, arg_min(id, pos) id
       from islands group by doc_id, page_index, isl)""",
    "trans": f"""trans as (select doc_id, page_index, {_ROLES_SQL}[(doc_id + page_index) % 18 + 1] as role, coalesce(string_agg(case when turn = 4 and pos % 3 = 0 then 'blur' when turn = 2 then token || ' ' || token else token end, ' ' order by pos)
       filter (not (turn = 0 or (turn = 1 and pos % 2 = 0) or (turn = 3 and pos % 5 = 0) or (turn > 4 and pos % 97 = 0))), '') as text, ((doc_id + page_index) % 5 = 0)::int orphan_notes
       from (select *, (doc_id * 7 + page_index) % 9 turn from (select doc_id, (pos - 1) // 250 page_index, pos, token from tok)) group by doc_id, page_index)""",
    "pages_": f"pages_ as (select doc_id // 50 book, doc_id % 50 page_index, doc_id, {_ROLES_SQL}[doc_id % 18 + 1] as role, text, lang, source from documents)",
}


def sql(names: str, query: str, recursive: bool = False) -> str:
    parts = [SQL[n] for n in names.split()]
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + query
