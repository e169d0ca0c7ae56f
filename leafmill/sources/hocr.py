"""Pages and words from hOCR text, with column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import rest

PAGE = r"(?s)<div[^>]*class=.ocr_page.[^>]*>"
WORD = r"(?s)<span([^>]*class=.ocrx_word.[^>]*)>(.*?)</span>"
ENTITY = "&(?:#x?[0-9a-fA-F]+|[a-zA-Z]+);"
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " "}


_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"
BOX = rf"(?s)^(?:.*;)?\s*bbox\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}\s+{_NUMBER}(?:[\s;]|$)"
CONFIDENCE = rf"(?s)^(?:.*;)?\s*x_wconf\s+{_NUMBER}(?:[\s;]|$)"


def box(title: Column) -> list[Column]:
    """x0, y0, x1, y1 of the last such clause of a title like ``bbox 1 2 3 4; x_wconf 90``; null without four numbers."""
    return [F.regexp_extract(title, BOX, k + 1).try_cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]


def confidence(title: Column) -> Column:
    return F.coalesce(F.regexp_extract(title, CONFIDENCE, 1).try_cast("double"), F.lit(0.0))


def _entity(e: Column) -> Column:
    """The sign of one entity; what is no sign stays."""
    decimal = F.regexp_extract(e, "^&#([0-9]+)", 1).try_cast("long")
    hexed = F.regexp_extract(e, "^&#x([0-9a-fA-F]{1,15});", 1)
    code = F.when(e.startswith("&#x"), F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("long"))).otherwise(decimal)
    whole = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    sign = F.when(whole, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    named = F.when(e == "&amp;", "&")
    for name, other in _NAMED.items():
        named = named.when(e == name, other)
    return F.coalesce(F.when(e.startswith("&#"), sign).otherwise(named), e)


def decoded(text: Column) -> Column:
    """Named and numbered entities decoded once."""
    signs = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), _entity)
    gaps = F.split(text, ENTITY, -1)
    whole = F.array_join(F.zip_with(gaps, F.array_append(signs, F.lit("")), lambda gap, sign: F.concat(gap, sign)), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def plain_text(inner: Column) -> Column:
    """Without tags, entities decoded, white space collapsed."""
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(inner, "<[^>]*>", "")), "[\\s\u00a0]+", " "))


def _title(tag: Column) -> Column:
    return F.regexp_extract(tag, r"""title=(["'])(.*?)\1""", 2)


def parse(files: DataFrame) -> DataFrame:
    """file_id, page_index, word_no, text, confidence, x0, y0, x1, y1 of each word (``files``: file_id, content).

    A page runs from its tag to the next; a word without a whole box is left out and takes no number.
    """
    parts = rest(F.split("content", PAGE, -1))
    pages = files.select("file_id", F.posexplode(parts).alias("page_index", "body"))

    def cut(span: Column) -> Column:
        """What stands inside a word's tag, and its title."""
        tag = F.substring_index(span, ">", 1)
        return F.struct(F.substring(span, F.length(tag) + 2, F.length(span) - F.length(tag) - 1 - len("</span>")).alias("inner"), _title(tag).alias("title"))

    def placed(w: Column) -> Column:
        """The numbers of its box in one string behind a mark, which is missing without a whole box."""
        return F.struct(w["inner"].alias("inner"), w["title"].alias("title"), F.regexp_replace(w["title"], BOX + "(?s).*", "\u0001$1 $2 $3 $4").alias("box"))

    # One search of the page; all else reads single words. A lambda's argument is made once, what it names is made at each
    # mention: so each step takes the last one's results as its argument, and each pattern runs once a word.
    words = F.transform(F.transform(F.regexp_extract_all("body", F.lit(WORD), F.lit(0)), cut), placed)
    words = F.filter(words, lambda w: F.startswith(w["box"], F.lit("\u0001")))
    rows = pages.select("file_id", "page_index", F.posexplode(words).alias("word_no", "w"))
    rows = rows.select("file_id", "page_index", "word_no", "w.inner", "w.title", F.split(F.substring("w.box", 2, 2147483647), " ").alias("box"))
    sides = [F.get("box", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("file_id", "page_index", "word_no", plain_text(F.col("inner")).alias("text"), confidence(F.col("title")).alias("confidence"), *sides)


def written(pages: Column) -> Column:
    """Pages of words (text, confidence, box), an array of arrays, as one hOCR text."""

    def span(w: Column) -> Column:
        safe = F.replace(F.replace(F.replace(w["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        numbers = [w[c].cast("string") for c in ("x0", "y0", "x1", "y1")]
        return F.concat(F.lit("<span class='ocrx_word' title='bbox "), F.concat_ws(" ", *numbers), F.lit("; x_wconf "), w["confidence"].cast("string"), F.lit("'>"), safe, F.lit("</span>"))

    body = lambda ws: F.concat(F.lit("<div class='ocr_page'>"), F.array_join(F.transform(ws, span), "\n"), F.lit("</div>"))
    return F.array_join(F.transform(pages, body), "\n")
