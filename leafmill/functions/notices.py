"""Checks of names and numbers, and the sentences that tell a reader what was found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .layout import trim_points
from .text import roman, slug

MB = 1024 * 1024
MOST_SCAN_BYTES = 40 * MB
FOOTINGS = ("stated", "implied", "context")
STATES = ("ended", "canceling", "in_progress")


def valid_repository(name: Column) -> Column:
    """Whether a name has the form owner/name."""
    return F.trim(name).rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")


def valid_session(name: Column) -> Column:
    return name.rlike("^[a-z0-9][a-z0-9-]{0,62}$") & ~F.contains(name, F.lit("\n"))


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


# Fixed wording.
def scan_refusal(size: Column) -> Column:
    """Why a scan of so many bytes isn't sent, or null."""
    said = F.concat(
        F.lit("The scan is "), _half_up(size / MB).cast("string"), F.lit(f" MB, past the {MOST_SCAN_BYTES // MB} MB this app will send — GitHub refuses a file over 100 MB and the upload is a third larger again. "
        "Everything else about the book was saved; opening it on another device will ask for the scan."),
    )
    return F.when(size > MOST_SCAN_BYTES, said)


# Fixed wording.
def ticket_line(pages: Column, submitted: Column, batches: Column, age: Column, model: Column) -> Column:
    """What a stored ticket is out for."""
    scope = F.when(submitted >= pages, F.concat(F.lit("all "), pages.cast("string"))).otherwise(F.concat_ws(" of ", submitted.cast("string"), pages.cast("string")))
    return F.concat(scope, F.lit(" page(s) submitted "), age, F.lit(" to "), model, F.lit(", in "), batches.cast("string"), F.lit(" batch"), F.when(batches == 1, "").otherwise("es"), F.lit("."))


# Fixed wording.
def second_look(spots: Column, not_there: Column, missing: Column, different: Column, unsure: Column, failures: Column) -> Column:
    """What a second look at doubtful spots found."""
    some = lambda n, said: F.when(n > 0, F.concat(n.cast("string"), F.lit(said)))
    each = lambda n, said: F.concat(n.cast("string"), F.lit(said))
    parts = F.concat_ws(
        " · ", each(spots, " spot(s) looked at again"), each(not_there, " were not on the page"), each(missing, " really were dropped"),
        some(different, " read differently from both"), some(unsure, " could not be settled"), some(failures, " leaf/leaves could not be checked"),
    )
    return F.concat(parts, F.lit("."))


# Fixed wording.
def vocabulary_request(terms: Column) -> Column:
    """The confirmed spellings as part of a page's request; empty without any."""
    said = "KNOWN VOCABULARY IN THIS WORK.\nThese spellings have been confirmed as correct for this book. Prefer them\nover similar modern words when the pixels are ambiguous, and reproduce them\nexactly:\n"
    return F.when(F.size(terms) == 0, "").otherwise(F.concat(F.lit(said), F.array_join(terms, ", ")))


# Fixed wording.
def vocabulary_reminder(terms: Column) -> Column:
    said = "Known vocabulary in this work — these spellings are CORRECT and must be\npreserved exactly. Do not modernize or substitute a similar modern word:\n"
    return F.when(F.size(terms) == 0, "").otherwise(F.concat(F.lit(said), F.array_join(terms, ", ")))


def response_failure(status: Column, body: Column) -> Column:
    """null for a good response, else its message and whether asking again may help."""
    detail = F.coalesce(F.get_json_object(F.when(F.try_parse_json(body).isNotNull(), body), "$.error.message"), F.lit(""))
    message = F.concat(F.lit("API error "), status.cast("string"), F.when(detail == "", "").otherwise(F.concat(F.lit(": "), detail)))
    return F.when(~status.between(200, 299), F.struct(message.alias("message"), ((status == 429) | (status >= 500)).alias("retryable")))


def batch_status(raw: Column) -> Column:
    """id, state and the count of results of a batch object; null where it has no id. Unknown states are still running."""
    at = lambda p: F.get_json_object(raw, p)
    count = lambda name: F.coalesce(at(f"$.request_counts.{name}").try_cast("double"), F.lit(0.0)).cast("long").alias(name)
    state = at("$.processing_status")
    known = F.when(state.isin(*STATES), state).otherwise("in_progress").alias("state")
    return F.when(F.coalesce(at("$.id"), F.lit("")) != "", F.struct(at("$.id").alias("id"), known, *map(count, ("processing", "succeeded", "errored"))))


def pick_number(answer: Column, otherwise: Column) -> Column:
    """An answer read as a number: blank counts as 0, what isn't a number gives way."""
    plain = F.trim(answer)
    return F.when(answer.isNull(), otherwise).when(plain == "", 0.0).otherwise(F.coalesce(F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain.try_cast("double")), otherwise))


def folio(index: Column, front_pages: Column, front: Column, lines: Column, suppressed: Column) -> Column:
    """A page's printed number: roman in front, counted anew behind; none on empty or unnumbered pages."""
    return F.when(suppressed | (lines == 0), None).when(front, roman(index + 1)).otherwise((index - front_pages + 1).cast("string"))


def running_head(mode: Column, title: Column, author: Column, chapter: Column, page_folio: Column) -> Column:
    return F.when(mode == "bookTitle", title).when(mode == "author", author).when(mode == "chapterTitle", F.coalesce(chapter, title)).when(mode == "pageNumber", F.coalesce(page_folio, F.lit(""))).otherwise("")


def head_baseline(top_inches: Column, size: Column) -> Column:
    return F.greatest(F.lit(12.0), top_inches * 72 - size * 1.2)


def foot_baseline(trim: Column, bottom_inches: Column, size: Column) -> Column:
    return trim_points(trim, 2) - bottom_inches * 72 + size * 1.6


def bank_stem(author: Column, title: Column, year: Column) -> Column:
    """author--title--year, of what there is."""
    digits = F.substring(F.regexp_replace(year, "[^0-9]", ""), 1, 4)
    parts = F.filter(F.array(slug(author), slug(title), digits), lambda x: x != "")
    return F.when(F.size(parts) == 0, "fact-bank").otherwise(F.array_join(parts, "--"))


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of an ASCII string."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


def body_key(blocks: Column) -> Column:
    """How many blocks, and a hash of their ids and lengths: another text has another key."""
    seed = F.array_join(F.transform(blocks, lambda b: F.concat_ws(":", b["id"], F.length(b["text"]).cast("string"))), "|")
    return F.concat(F.size(blocks).cast("string"), F.lit("-"), F.lower(F.conv(fnv1a(seed).cast("string"), 10, 36)))


def last_word_index(before: Column) -> Column:
    """The word that a mark behind this text belongs to, from 0."""
    return F.greatest(F.lit(0), F.size(F.filter(F.split(before, r"\s+"), lambda w: w != "")) - 1)


def width_for_line(widths: Column, line: Column) -> Column:
    """A line's measure: the last of the list holds for all that follow."""
    return F.when(F.size(widths) == 0, 0.0).otherwise(F.get(widths, F.least(line, F.size(widths) - 1)))


def progress(done: Column, total: int) -> Column:
    return F.struct(done.alias("done"), F.lit(total).alias("total"), _half_up(done / total * 100).alias("pct"))


def saved_look(trim: Column, font: Column, size: Column, imprint: Column) -> Column:
    return F.concat_ws(" · ", F.concat(trim, F.lit("in")), F.concat(font, F.lit(" at "), size.cast("string"), F.lit("pt")), F.when(imprint != "", imprint))


def facts_in(raw: Column) -> Column:
    """The usable facts of a reply (null: none), and how many entries were dropped for want of a title or a body."""
    kind = "array<struct<title:string,body:string,footing:string,category:string,blockId:string,quote:string>>"
    given = F.coalesce(F.from_json(F.get_json_object(raw, "$.facts"), kind), F.array().cast(kind))
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    tag = lambda c: F.lower(F.trim(F.translate(F.coalesce(c, F.lit("")), "_", " ")))
    good = F.filter(given, lambda f: (plain(f["title"]) != "") & (plain(f["body"]) != ""))
    read = lambda f: F.struct(
        plain(f["title"]).alias("title"), plain(f["body"]).alias("body"), F.when(f["footing"].isin(*FOOTINGS), f["footing"]).otherwise("context").alias("footing"),
        F.when(tag(f["category"]) == "", "general").otherwise(tag(f["category"])).alias("category"), F.coalesce(f["blockId"], F.lit("")).alias("block_id"), plain(f["quote"]).alias("quote"),
    )
    return F.struct(F.transform(good, read).alias("facts"), (F.size(given) - F.size(good)).alias("discarded"))


def about_book(raw: Column) -> Column:
    """What a shelf says of a book: null without a key; blanks filled in."""
    at = lambda p: F.get_json_object(raw, p)
    key = F.coalesce(at("$.key"), F.lit(""))
    found = F.struct(
        key.alias("key"), F.coalesce(at("$.fileName"), F.lit("a book")).alias("file_name"), F.coalesce(at("$.pageCount").try_cast("long"), F.lit(0).cast("long")).alias("pages"),
        (F.coalesce(at("$.complete"), F.lit("true")) != "false").alias("complete"),
    )
    return F.when(key != "", found)
