"""Column functions on words, lines and names."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.views import BLANK

# Marks that no typesetter puts inside a word, and spellings held for old.
JUNK = r"[~^«»£†°|\\/<>*_{}\[\]@#$%+=]"
ARCHAIC = ["ſ", "(?i)(eth|est)$", "(?i)(all|ell|ill|oll|ull)$", "(?i)^ye$", "(?iu)æ|œ", "(?i)ies?$"]


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits, straight apostrophes and hyphens."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}'-]+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, BLANK + "+"), lambda x: x != "")).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def strip_soft_hyphens(text: Column) -> Column:
    return F.replace(text, F.lit("\xad"), F.lit(""))


def join_text(previous: Column, following: Column) -> Column:
    """Two parts of a paragraph: a letter's trailing hyphen goes and joins them, else a blank does."""
    a, b = F.rtrim(previous), F.ltrim(following)
    return F.when(a.rlike("\\p{L}[-\xad]$"), F.concat(F.regexp_replace(a, "[-\xad]$", ""), b)).otherwise(F.concat_ws(" ", a, b))


def superscript(digits: Column) -> Column:
    return F.translate(digits, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def normalize_token(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", ""))


def edit_distance(a: Column, b: Column, most: int = 1) -> Column:
    found = F.levenshtein(a, b, most)
    return F.when(found < 0, most + 1).otherwise(found)


def archaic_score(term: Column) -> Column:
    return sum((term.rlike(p).cast("int") for p in ARCHAIC), F.lit(0))


def role_label(role: Column) -> Column:
    return F.array_join(F.transform(F.split(role, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 2147483647))), " ")


def tail_of(text: Column, chars: int = 400) -> Column:
    return F.right(F.trim(text), F.lit(chars))


def slug(value: Column, most: int = 48) -> Column:
    """Letters and digits kept, all else one hyphen, ends trimmed, at most ``most`` characters."""
    plain = F.regexp_replace(F.lower(F.trim(value)), r"[^\p{L}\p{N}]+", "-")
    return F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, most)


def _letters() -> dict[str, str]:
    """All signs whose compatibility form begins with a plain letter or digit, and that form without its marks."""
    found = {}
    for code in range(128, 0x1F200):
        form = unicodedata.normalize("NFKD", chr(code)) if not 0xD800 <= code < 0xE000 else ""
        bare = "".join(c for c in form if not "\u0300" <= c <= "\u036f")
        if bare != chr(code) and any(c.isascii() and c.isalnum() for c in bare):
            found[chr(code)] = bare
    return found


def safe_file_name(title: Column, ending: str) -> Column:
    """A title as a file's name: letters without accents and digits, all else one hyphen, at most 60 signs; book without any."""
    letters = _letters()
    one = {a: b for a, b in letters.items() if len(b) == 1 and a <= "\uffff"}
    # A map is searched from its start for each sign: only what becomes several is left to it, and plain signs pass by.
    more = F.from_json(F.lit(json.dumps({a: b for a, b in letters.items() if a not in one})), "map<string,string>")
    bare = F.translate(F.regexp_replace(F.coalesce(title, F.lit("")), "[\u0300-\u036f]", ""), "".join(one), "".join(one.values()))
    spelt = F.array_join(F.transform(F.split(bare, ""), lambda c: F.when(c < "\u0080", c).otherwise(F.coalesce(F.try_element_at(more, c), c))), "")
    stem = F.regexp_replace(F.regexp_replace(spelt, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.coalesce(F.nullif(F.lower(F.substring(stem, 1, 60)), F.lit("")), F.lit("book")), F.lit("." + ending))


def file_name(title: Column) -> Column:
    """A title without its scan's ending, as a slug, with the ending of a book file."""
    return F.concat(slug(F.regexp_replace(title, r"(?i)\.(pdf|epub)$", ""), 60), F.lit(".book.json"))


def readable_bytes(n: Column) -> Column:
    kb, mb = n / 1024, n / (1024 * 1024)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(mb < 1, F.concat(F.floor(kb + 0.5).cast("string"), F.lit(" KB"))).otherwise(
        F.concat(F.format_string("%.1f", mb), F.lit(" MB"))
    )


def custom_id(page: Column) -> Column:
    """page- and five digits at least (lpad alone would cut longer ones)."""
    digits = page.cast("string")
    return F.concat(F.lit("page-"), F.when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0")))


def page_of(custom: Column) -> Column:
    return F.when(custom.rlike(r"^page-\d{1,9}$"), F.regexp_extract(custom, r"(\d+)$", 1).cast("long"))


def age(saved: Column, now: Column) -> Column:
    """How long ago, in whole minutes, hours, days or months; parts of a second count, so that no minute is full too early."""
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(saved.cast("timestamp"))) / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    months = F.floor(days / 30)

    def said(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return F.when(minutes < 1, "just now").when(minutes < 60, said(minutes, "minute")).when(hours < 24, said(hours, "hour")).when(
        days < 30, said(days, "day")
    ).otherwise(said(months, "month"))


def roman(n: Column) -> Column:
    """Lower-case Roman numeral of a whole number below 4000."""
    out = F.lit("")
    for k, (one, five, ten) in enumerate([("m", "", ""), ("c", "d", "m"), ("x", "l", "c"), ("i", "v", "x")]):
        digit = F.floor(n / 10 ** (3 - k)) % 10
        shapes = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        out = F.concat(out, F.element_at(F.array(*map(F.lit, shapes)), (digit + 1).cast("int")))
    return out


def table_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda row: F.array_join(row, " | ")), "\n")


def parse_table(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.transform(F.split(x, "\\|"), lambda c: F.trim(c)))


def rest(items: Column) -> Column:
    """All of an array but its first."""
    return F.slice(items, 2, F.greatest(F.lit(0), F.size(items) - 1))
