"""Inline markup, anchors, claims and corrections of a text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..plans.views import BLANK
from .notices import fnv1a

# Tags that mean italics, and tags that mean nothing here.
ITALIC, TRANSPARENT = ("i", "em", "cite", "var"), ("sup", "sub", "b", "strong", "span", "p", "small")
_TAG = r"(?i)<(/?)(%s)(?:\s[^<>]*)?/?>" % "|".join(ITALIC + TRANSPARENT)
_ITALIC = r"(?i)^</?(?:%s)[\s/>]" % "|".join(ITALIC)


_WORD = f"[^{BLANK[1:-1]}]"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is made once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(text: Column) -> Column:
    """Words and what lies between them, in turns."""
    return F.regexp_extract_all(text, F.lit(f"{BLANK}+|{_WORD}+"), F.lit(0))


def parsed_markup(raw: Column) -> Column:
    """text without known tags, and emphasis: the places of the words that italics touch; an open tag runs to the end."""
    ranges = "array<struct<a:int,b:int>>"

    def parts(raw: Column) -> Column:
        tag = lambda t: F.struct(t.rlike(_ITALIC).alias("italic"), t.startswith("</").alias("ends"))
        tags = F.transform(F.regexp_extract_all(raw, F.lit(_TAG), F.lit(0)), tag)
        last = F.struct(F.lit(False).alias("italic"), F.lit(False).alias("ends"))
        return F.arrays_zip(F.split(raw, _TAG, -1).alias("gap"), F.concat(tags, F.array(last)).alias("tag"))

    def step(s: Column, x: Column) -> Column:
        size = s["size"] + F.length(x["gap"])
        italic, ends = x["tag"]["italic"], x["tag"]["ends"]
        depth = F.when(italic & ~ends, s["depth"] + 1).when(italic & (s["depth"] > 0), s["depth"] - 1).otherwise(s["depth"])
        begun = F.when(italic & ~ends & (s["depth"] == 0), size).otherwise(s["begun"])
        closed = italic & ends & (s["depth"] == 1)
        found = F.when(closed, F.concat(s["ranges"], F.array(F.struct(begun.alias("a"), size.alias("b"))).cast(ranges))).otherwise(s["ranges"])
        return F.struct(size.alias("size"), depth.alias("depth"), begun.alias("begun"), found.alias("ranges"))

    zero = F.lit(0)
    start = F.struct(zero.alias("size"), zero.alias("depth"), zero.alias("begun"), F.array().cast(ranges).alias("ranges"))
    end = lambda s: F.when(s["depth"] > 0, F.concat(s["ranges"], F.array(F.struct(s["begun"].alias("a"), s["size"].alias("b"))).cast(ranges))).otherwise(s["ranges"])
    none = F.array().cast("array<int>")

    def touched(text: Column, r: Column) -> Column:
        """Words from the one that goes on or begins at a range's start to the last that begins before its end."""
        begun = lambda at: F.regexp_count(F.substring(text, F.lit(1), at), F.lit(f"{_WORD}+"))
        inside = (r["a"] > 0) & F.substring(text, r["a"], F.lit(2)).rlike(f"^{_WORD}{{2}}$")
        first, last = begun(r["a"]) - inside.cast("int"), begun(r["b"]) - 1
        return F.when(first <= last, F.sequence(first, last)).otherwise(none)

    def read(pairs: Column) -> Column:
        found = F.struct(F.array_join(F.transform(pairs, lambda x: x["gap"]), "").alias("text"), F.aggregate(pairs, start, step, end).alias("spans"))
        # No list grows word by word: each of its copies would be as long as the text.
        words = lambda f: F.array_distinct(F.flatten(F.transform(f["spans"], lambda r: touched(f["text"], r))))
        return _let(found, lambda f: F.struct(f["text"].alias("text"), words(f).alias("emphasis")))

    return _let(_let(F.coalesce(raw, F.lit("")), parts), read)


def with_markup(text: Column, emphasis: Column) -> Column:
    """The inverse: neighbouring emphasised words share a pair of tags."""

    def marks(s: Column) -> Column:
        """The places to mark, each once, in order."""
        inside = F.filter(F.coalesce(emphasis.cast("array<int>"), F.array().cast("array<int>")), lambda k: (k >= 0) & (k * 2 + s["lead"] < F.size(s["chunks"])))
        return F.sort_array(F.array_distinct(inside))

    def flags(marks: Column) -> Column:
        """For each word up to the last marked one whether it is."""
        before = lambda i: F.coalesce(F.get(marks, i - 1), F.lit(-1))
        return F.flatten(F.transform(marks, lambda m, i: F.concat(F.array_repeat(F.lit(False), m - before(i) - 1), F.array(F.lit(True)))))

    def put(s: Column, flags: Column) -> Column:
        has = lambda k: F.coalesce(F.get(flags, k), F.lit(False))

        def chunk(c: Column, i: Column) -> Column:
            k = F.floor((i - s["lead"]) / 2).cast("int")
            opened, closed = F.when(has(k - 1), "").otherwise("<i>"), F.when(has(k + 1), "").otherwise("</i>")
            return F.when(((i - s["lead"]) % 2 == 0) & has(k), F.concat(opened, c, closed)).otherwise(c)

        return F.array_join(F.transform(s["chunks"], chunk), "")

    # Words and blanks take turns, from the one that the text begins with.
    split = lambda t: F.struct(_chunks(t).alias("chunks"), t.rlike(f"^{BLANK}").cast("int").alias("lead"))
    return _let(_let(F.coalesce(text, F.lit("")), split), lambda s: _let(_let(marks(s), flags), lambda f: put(s, f)))


def normalized_markup(text: Column, emphasis: Column) -> Column:
    """text and emphasis of a block that came some other way: tags are read as they are elsewhere; a text without any, or with
    none that marks a word, keeps its emphasis."""

    def chosen(text: Column, read: Column) -> Column:
        changed = F.contains(text, F.lit("<")) & (read["text"] != text)
        kept = F.when(changed & (F.size(read["emphasis"]) > 0), read["emphasis"]).otherwise(emphasis)
        return F.struct(F.when(changed, read["text"]).otherwise(text).alias("text"), kept.alias("emphasis"))

    return _let(text, lambda t: _let(parsed_markup(t), lambda read: chosen(t, read)))


def correct_terms(text: str | None, corrections: list[tuple[str, str]]) -> tuple[str, int]:
    """Whole words replaced in order, each also in its capitalised form; how many were."""
    text, total = text or "", 0
    for wrong, right in corrections:
        for a, b in dict.fromkeys([(wrong, right), (wrong[:1].upper() + wrong[1:], right[:1].upper() + right[1:])]):
            if a and a != b:
                text, n = re.subn(rf"(?<![\w-]){re.escape(a)}(?![\w-])", lambda _, b=b: b, text)
                total += n
    return text, total


def anchor_end(block: Column, anchor: Column) -> Column:
    """Where an anchor ends in a block, white space loose, in its own case or else in any; null where it isn't."""
    words = F.filter(F.split(anchor, f"{BLANK}+"), lambda w: w != "")
    quoted = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.array_join(quoted, f"{BLANK}+")

    def end(p: Column) -> Column:
        parts = F.split(block, p, 2)
        return F.when(F.size(parts) == 2, F.length(block) - F.length(F.get(parts, F.lit(1))))

    return F.when(F.size(words) > 0, F.coalesce(end(pattern), end(F.concat(F.lit("(?iu)"), pattern))))


def claims_in(text: Column) -> Column:
    """Numbers, and capitalised words that don't begin a sentence; each once, in order."""
    sentences = F.split(F.coalesce(text, F.lit("")), f"(?<=[.!?]){BLANK}+")
    words = F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(r"\p{Nd}[\p{Nd},.]*\p{Nd}|\p{Nd}|\p{L}[\p{L}\p{N}_'’-]*"), F.lit(0)))
    claim = lambda w, k: w.rlike(r"^\p{Nd}") | ((k > 0) & w.rlike(r"^\p{Lu}") & (F.length(w) >= 2))
    return F.array_distinct(F.flatten(F.transform(words, lambda ws: F.filter(ws, claim))))


def short_hash(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a string, in digits and small letters."""
    return F.lower(F.conv(fnv1a(F.coalesce(text, F.lit(""))).cast("string"), 10, 36))


def correcting(corrections: list[tuple[str, str]]):
    """A pandas function of a text column that applies these corrections: struct of text and replaced."""

    @F.pandas_udf(StructType().add("text", StringType()).add("replaced", IntegerType()))
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([correct_terms(t, corrections) for t in text], columns=["text", "replaced"])

    return run


corrected = correcting([("thand", "than"), ("die", "dye")])
