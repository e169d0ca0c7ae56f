"""Stored records of any age read as variants: each field by its own type or not at all, records refused or mended by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.notices import FOOTINGS
from .stored import KINDS

EPOCH = "1970-01-01T00:00:00.000Z"
#: What a proposed note can be, and the version of a checkpoint that can be taken up again.
NOTE_KINDS = ("archaic-word", "person", "place", "measure", "obsolete-science", "allusion", "context", "concept")
CHECKPOINT = 1
_NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL\(.*)"


def parsed(body: Column) -> Column:
    """The variant of an object's JSON; null for all else."""
    v = F.try_parse_json(body)
    return F.when(_type(v).startswith("OBJECT"), v)


def read(records: DataFrame) -> DataFrame:
    """id, v: each record's body, parsed once. Spark doesn't carry a condition past the generator, where each field that it
    names would parse the body anew."""
    return records.select("id", F.explode(F.array(F.try_parse_json("body"))).alias("v")).select("id", F.when(_type(F.col("v")).startswith("OBJECT"), F.col("v")).alias("v"))


def once(rows: DataFrame, **fields: Column) -> DataFrame:
    """id and ``fields``, each made once, also where a condition names it more often."""
    return rows.select("id", F.inline(F.array(F.struct(*(c.alias(n) for n, c in fields.items())))))


def _type(v: Column, path: str = "$") -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, path: str, default: str | None = None) -> Column:
    """A string, not what could be turned into one."""
    return F.coalesce(F.when(_type(v, path) == "STRING", F.try_variant_get(v, path, "string")), F.lit(default))


def number(v: Column, path: str, default: float | None = None) -> Column:
    return F.coalesce(F.when(_type(v, path).rlike(_NUMBERS), F.try_variant_get(v, path, "double")), F.lit(default).cast("double"))


def true(v: Column, path: str, default: bool = False) -> Column:
    return F.coalesce(F.when(_type(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(default))


def items(v: Column, path: str) -> Column:
    """The members of an array; null where there is none."""
    return F.when(_type(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def _objects(v: Column, path: str) -> Column:
    return F.filter(F.coalesce(items(v, path), F.array().cast("array<variant>")), lambda x: F.coalesce(_type(x).startswith("OBJECT"), F.lit(False)))


def tickets(records: DataFrame) -> DataFrame:
    """id, key, file_name, submitted_at, model_id, page_count, complete, batches (id, pages, collected), corrections (said,
    meant) of each usable ticket (id, body): batches without an id go, a ticket without batches or key is none."""
    v = F.col("v")
    whole = lambda x: F.transform(F.filter(F.coalesce(items(x, "$.pageIndexes"), F.array().cast("array<variant>")), lambda p: (number(p, "$") == F.floor(number(p, "$")))), lambda p: number(p, "$").cast("int"))
    batch = lambda x: F.struct(text(x, "$.id").alias("id"), whole(x).alias("pages"), true(x, "$.collected").alias("collected"))
    batches = F.transform(F.filter(_objects(v, "$.batches"), lambda x: text(x, "$.id", "") != ""), batch)
    said = lambda x: text(x, "$.from").isNotNull() & text(x, "$.to").isNotNull()
    corrections = F.transform(F.filter(_objects(v, "$.termCorrections"), said), lambda x: F.struct(text(x, "$.from").alias("said"), text(x, "$.to").alias("meant")))
    rows = read(records).select(
        "id", text(v, "$.key").alias("key"), text(v, "$.fileName", "a book").alias("file_name"), text(v, "$.submittedAt", EPOCH).alias("submitted_at"), text(v, "$.modelId", "unknown").alias("model_id"),
        number(v, "$.pageCount", 0).cast("long").alias("page_count"), true(v, "$.complete").alias("complete"), batches.alias("batches"), corrections.alias("corrections"),
    )
    return rows.where("key is not null and size(batches) > 0")


def checkpoints(records: DataFrame) -> DataFrame:
    """id, key, body_key, mode, chunks_done, chunks_total, proposals, n_facts, failures, input_tokens of each checkpoint that can
    be taken up: of this version, with all its parts; one proposal that can't be read refuses the whole."""
    v = F.col("v")
    mode = F.when(text(v, "$.mode").isin("facts", "notes"), text(v, "$.mode"))
    proposal = lambda x: F.struct(*(text(x, f"$.{f}", "").alias(n) for f, n in (("blockId", "block_id"), ("anchorText", "anchor"), ("kind", "kind"), ("text", "text"), ("reason", "reason"))))
    good = lambda x: text(x, "$.kind").isin(*NOTE_KINDS) & (text(x, "$.blockId", "") != "") & (text(x, "$.text", "") != "")
    found, facts, failures = items(v, "$.proposals"), items(v, "$.facts"), items(v, "$.failures")
    all_good = F.forall(found, lambda x: F.coalesce(good(x), F.lit(False)))
    none = F.array().cast("array<variant>")
    failed = F.forall(F.coalesce(failures, none), lambda x: F.coalesce(_type(x).startswith("OBJECT"), F.lit(False)))
    failure = lambda x: F.struct(number(x, "$.chunkIndex", 0).cast("long").alias("chunk"), text(x, "$.message", "").alias("message"))
    ok = (number(v, "$.version") == CHECKPOINT) & mode.isNotNull() & (text(v, "$.key", "") != "") & (text(v, "$.bodyKey", "") != "") & found.isNotNull() & facts.isNotNull() & all_good & failed
    return read(records).where(ok).select(
        "id", text(v, "$.key").alias("key"), text(v, "$.bodyKey").alias("body_key"), mode.alias("mode"), number(v, "$.chunksDone", 0).cast("long").alias("chunks_done"), number(v, "$.chunksTotal", 0).cast("long").alias("chunks_total"),
        F.transform(found, proposal).alias("proposals"), F.size(facts).alias("n_facts"), F.transform(F.coalesce(failures, none), failure).alias("failures"), number(v, "$.usage.inputTokens", 0).cast("long").alias("input_tokens"),
    )


def run_facts(records: DataFrame) -> DataFrame:
    """id, fact_id, title, body, footing, tags, source_page, verified of the well-formed facts that runs (id, body) hold."""
    rows = records.select("id", F.explode(_objects(parsed(F.col("body")), "$.facts")).alias("v"))
    v = F.col("v")
    tags = F.transform(F.filter(F.coalesce(items(v, "$.tags"), F.array().cast("array<variant>")), lambda t: F.coalesce(_type(t) == "STRING", F.lit(False))), lambda t: text(t, "$"))
    good = text(v, "$.footing").isin(*FOOTINGS) & (text(v, "$.id", "") != "") & (text(v, "$.title", "") != "")
    return rows.where(good).select(
        "id", text(v, "$.id").alias("fact_id"), text(v, "$.title").alias("title"), text(v, "$.body", "").alias("body"), text(v, "$.footing").alias("footing"), tags.alias("tags"),
        number(v, "$.sourcePage").cast("long").alias("source_page"), true(v, "$.quoteVerified").alias("verified"),
    )


def run_verdicts(records: DataFrame) -> DataFrame:
    """id, spot, verdict, reading, note of what a second reading found, of runs (id, body); what has no verdict is left out."""
    spots = F.try_variant_get(parsed(F.col("body")), "$.adjudicated", "map<string,variant>")
    rows = records.select("id", F.explode(spots).alias("spot", "v"))
    v = F.col("v")
    return rows.where(text(v, "$.verdict").isNotNull()).select("id", "spot", text(v, "$.verdict").alias("verdict"), text(v, "$.reading", "").alias("reading"), text(v, "$.note", "").alias("note"))


def introductions(records: DataFrame) -> DataFrame:
    """id, title, text, refused (why there is none) of replies (id, body) that should hold an introduction."""
    v = F.col("v")
    paragraphs = items(v, "$.paragraphs")
    prose = F.filter(F.transform(F.filter(paragraphs, lambda p: F.coalesce(_type(p) == "STRING", F.lit(False))), lambda p: F.trim(text(p, "$"))), lambda p: p != "")
    # Fixed wording.
    refused = F.when(paragraphs.isNull(), "The reply did not contain an introduction").when(F.size(prose) == 0, "The introduction came back empty")
    title = F.trim(text(v, "$.title", ""))
    rows = read(records)
    ok = refused.isNull()
    return rows.select("id", F.when(ok, F.when(title == "", "Introduction").otherwise(title)).alias("title"), F.when(ok, F.array_join(prose, "\n\n")).alias("text"), refused.alias("refused"))


def saved_looks(records: DataFrame) -> DataFrame:
    """id, look_id, name, saved_at, imprint, holder, public_domain of stored looks (id, body); only one without an id is none."""
    v = F.col("v")
    rows = read(records).where(text(v, "$.id", "") != "")
    return rows.select(
        "id", text(v, "$.id").alias("look_id"), text(v, "$.name", "Untitled look").alias("name"), text(v, "$.savedAt", EPOCH).alias("saved_at"),
        text(v, "$.imprint.imprint", "").alias("imprint"), text(v, "$.imprint.copyrightHolder", "").alias("holder"), true(v, "$.imprint.publicDomainNotice", True).alias("public_domain"),
    )


#: Fixed value: the question whose answer is a credential.
CREDENTIALS = ("apiKey",)


def commands(records: DataFrame) -> DataFrame:
    """id, op, ref, question, value (JSON), reason of commands off the wire (id, body): what is asked, or why it is refused."""
    v = F.col("v")
    op, ref, question = text(v, "$.op"), text(v, "$.ref"), text(v, "$.id")
    value = F.try_variant_get(v, "$.value", "variant")
    kind = _type(value)
    listed = F.forall(F.when(kind.startswith("ARRAY"), value.try_cast("array<variant>")), lambda x: F.coalesce(_type(x) == "STRING", F.lit(False)))
    held = F.when(kind.startswith("OBJECT"), value.try_cast("map<string,variant>"))
    mapped = F.forall(F.map_values(held), lambda x: F.coalesce(_type(x) == "STRING", F.lit(False)))
    valid = F.coalesce(kind.isin("STRING", "BOOLEAN") | F.coalesce(listed, F.lit(False)) | F.coalesce(mapped, F.lit(False)), F.lit(False))
    shown = F.coalesce(op, F.when(_type(v, "$.op").isNotNull() & (_type(v, "$.op") != "VOID"), F.try_variant_get(v, "$.op", "string")).when(_type(v, "$.op") == "VOID", "null").otherwise("undefined"))
    # Fixed wording.
    reason = (
        F.when(v.isNull(), "A command must be an object.")
        .when(op.isin("state", "advance"), F.lit(None).cast("string"))
        .when(op == "evidence", F.when(F.coalesce(ref, F.lit("")) == "", "An `evidence` command needs the `ref` a snapshot gave it."))
        .when(
            op == "answer",
            F.when(F.coalesce(question, F.lit("")) == "", "An `answer` command needs the question `id`.")
            .when(question.isin(*CREDENTIALS), F.concat(F.lit("“"), question, F.lit("” is a credential. It is typed by the person whose credential it is, into the browser that stores it — it does not travel this channel in either direction.")))
            .when(~valid, "An answer must be a string, a boolean, an array of strings, or an object of string to string."),
        )
        .otherwise(F.concat(F.lit("Unknown command “"), shown, F.lit("”.")))
    )
    rows = read(records).withColumn("reason", reason)
    ok = F.col("reason").isNull()
    return rows.select(
        "id", F.when(ok, op).alias("op"), F.when(ok & (op == "evidence"), ref).alias("ref"), F.when(ok & (op == "answer"), question).alias("question"), F.when(ok & (op == "answer"), F.to_json(value)).alias("value"), "reason",
    )


_OPS = "array<struct<op:string,x:int,y:int,width:int,height:int,degrees:int>>"


def edit_log(records: DataFrame) -> DataFrame:
    """id, kind, target, value, at, level, block_id, width, height, title, placement, ops of the well-formed edits (id, body) of all
    ten kinds, as ``edits.replayed`` and ``additions`` take them. An edit that lacks what its kind asks for goes."""
    v = F.col("v")
    op = lambda o: F.struct(text(o, "$.op").alias("op"), *(number(o, f"$.params.{c}").cast("int").alias(c) for c in ("x", "y", "width", "height", "degrees")))
    good_op = lambda o: text(o, "$.op").isNotNull() & F.coalesce(_type(o, "$.params").startswith("OBJECT"), F.lit(False))
    texts = {"kind": "kind", "words": "text", "block_kind": "blockKind", "after": "afterBlockId", "placement": "placement", "title": "title", "image": "imageId", "illustration": "illustrationId", "section": "sectionId", "note": "noteId"}
    numbers = {"at": "at", "level": "level", "source_width": "sourceWidth", "source_height": "sourceHeight"}
    fields = {n: text(v, f"$.{f}") for n, f in texts.items()} | {n: number(v, f"$.{f}") for n, f in numbers.items()} | {"block": text(v, "$.blockId", ""), "after_type": _type(v, "$.afterBlockId")}
    rows = once(read(records), **fields, ops=F.transform(F.filter(_objects(v, "$.ops"), good_op), op).cast(_OPS))
    kind, block, words, at, ops = (F.col(c) for c in ("kind", "block", "words", "at", "ops"))
    placed = F.col("after_type").isin("STRING", "VOID")
    named = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    asks = {
        "text": (block != "") & words.isNotNull(), "retype": (block != "") & F.col("block_kind").isin(KINDS), "drop": block != "", "split": (block != "") & at.isNotNull(), "merge": block != "",
        "image": named("image") & placed & F.col("source_width").isNotNull() & F.col("source_height").isNotNull(), "retouch": named("illustration") & (F.size(ops) > 0),
        "section": named("section") & F.col("placement").isin("front", "back") & F.col("title").isNotNull() & words.isNotNull(), "note": named("note") & (block != "") & at.isNotNull() & words.isNotNull(),
        "anchor": named("illustration") & placed,
    }
    names = {"image": "image", "retouch": "illustration", "section": "section", "note": "note", "anchor": "illustration"}
    good, target = F.lit(False), block
    for k, asked in asks.items():
        good = F.when(kind == k, asked).otherwise(good)
        target = F.when(kind == k, F.col(names[k])).otherwise(target) if k in names else target
    only = lambda c, *kinds: F.when(kind.isin(*kinds), c)
    return rows.where(F.coalesce(good, F.lit(False))).select(
        "id", kind.alias("kind"), target.alias("target"), F.when(kind == "retype", F.col("block_kind")).otherwise(only(words, "text", "section", "note")).alias("value"), only(at.cast("int"), "split", "note").alias("at"),
        only(F.col("level").cast("int"), "retype").alias("level"), F.when(kind == "note", block).otherwise(only(F.col("after"), "image", "anchor")).alias("block_id"),
        only(F.col("source_width").cast("int"), "image").alias("width"), only(F.col("source_height").cast("int"), "image").alias("height"), only(F.col("title"), "section").alias("title"),
        only(F.col("placement"), "section").alias("placement"), only(ops, "retouch").alias("ops"),
    )
