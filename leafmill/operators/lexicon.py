"""The collection's own vocabulary, from scanned words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import archaic_score, edit_distance, normalize_token, rest
from ..plans.scratch import drop, keep

LEAST_COUNT, LOW_CONFIDENCE, LIMIT = 3, 80, 200


def forms(words: DataFrame) -> DataFrame:
    """key, form, n, confidence, first, pages: spellings of the words (text, confidence, page, at), counted where they lie."""
    # Words as they stand are counted first, so that each different one is brought to its form once and not where it occurs.
    # They are counted by document before, with plain numbers for places: a least place as a struct would have all words sorted.
    each = words.groupBy("text", F.col("at")["doc"].alias("doc")).agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"), F.min(F.col("at")["pos"]).alias("pos"))
    raw = each.groupBy("text").agg(F.sum("n").alias("n"), F.sum("confidence").alias("confidence"), F.min("doc").alias("doc"), F.min_by("pos", "doc").alias("pos"))
    raw = raw.select("text", "n", "confidence", F.struct("doc", "pos").alias("first"))
    term = normalize_token(F.col("text"))
    named = raw.select(term.alias("form"), F.lower(term).alias("key"), "n", "confidence", "first")
    named = named.where((F.length("form") >= 3) & F.col("form").rlike(r"\p{L}"))
    return named.groupBy("key", "form").agg(F.sum("n").alias("n"), F.sum("confidence").alias("confidence"), F.min("first").alias("first"))


def entries(words: DataFrame, common: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """key, term, count, mean_confidence, archaic, known, proper, signals of each word that deserves a look.

    ``common`` has the ordinary words (word). A term is the most frequent spelling, the first seen of equals.
    """
    spelled = forms(words)
    keyed = spelled.groupBy("key").agg(
        F.max_by("form", F.struct("n", -F.col("first")["doc"], -F.col("first")["pos"])).alias("term"),
        F.sum("n").alias("count"), (F.sum("confidence") / F.sum("n")).alias("mean_confidence"),
    )
    known = common.select(F.col("word").alias("key"), F.lit(True).alias("known")).distinct()
    return _worth_a_look(keyed.join(known, "key", "left").withColumn("known", F.coalesce("known", F.lit(False))), least)


def _worth_a_look(keyed: DataFrame, least: int) -> DataFrame:
    """The entries among keys (key, term, count, mean_confidence, known)."""
    keyed = keyed.where(~F.col("known") & (F.col("count") >= least)).withColumn("archaic", archaic_score(F.col("term")))
    keyed = keyed.withColumn("proper", F.col("term").rlike(r"^\p{Lu}"))
    signals = F.array_compact(
        F.array(
            F.lit("frequent-unknown"),
            F.when(F.col("archaic") > 0, "archaic-orthography"),
            F.when(F.col("mean_confidence") < LOW_CONFIDENCE, "low-confidence"),
            F.when(F.col("proper"), "proper-noun"),
        )
    )
    columns = ("key", "term", "count", "mean_confidence", "known", "archaic", "proper")
    return keyed.select(*columns, signals.alias("signals"))


#: White space beyond ASCII's in ``views.BLANK``.
_WIDE = "[\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

_COUNTED = "key string, form string, n long, confidence double, doc long, pos long, docs long"


def _spellings(batch: pa.RecordBatch, confidence: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.RecordBatch:
    """The spellings of some whole documents, with how many of these have the word in any spelling beside one of each word."""
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(batch["text"].fill_null(""), _WIDE, " "))
    flat = words.values.dictionary_encode()
    text = flat.indices.to_numpy()
    row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    some = text != pc.index(flat.dictionary, "").as_py()  # a text may begin or end with blanks
    text, row = text[some], row[some]
    n_words = np.bincount(row, minlength=len(words))
    pos = np.arange(1, len(row) + 1) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    docs = batch["doc_id"].dictionary_encode(null_encoding="encode")
    doc = docs.indices.to_numpy().astype(np.int64)[row]
    sure = confidence(docs.dictionary.fill_null(0).to_numpy()[doc], pos)

    bare = pc.replace_substring_regex(flat.dictionary, r"^[^\p{L}\p{N}]+", "")
    forms_ = pc.replace_substring_regex(bare, r"[^\p{L}\p{N}]+$", "").dictionary_encode()
    keys = pc.utf8_lower(forms_.dictionary).dictionary_encode()
    key, n_forms, n_keys = keys.indices.to_numpy(), len(forms_.dictionary), len(keys.dictionary)
    form = forms_.indices.to_numpy()[text]

    first = np.full(n_forms, np.iinfo(np.int64).max)
    np.minimum.at(first, form, doc << 32 | pos)
    seen = pc.unique(pa.array(doc * n_keys + key[form])).to_numpy() % max(n_keys, 1)
    beside = np.zeros(n_forms, np.int64)
    beside[np.unique(key, return_index=True)[1]] = np.bincount(seen, minlength=n_keys)
    n = np.bincount(form, minlength=n_forms)
    columns = [
        keys.dictionary.take(keys.indices), forms_.dictionary, pa.array(n), pa.array(np.bincount(form, sure, n_forms), pa.float64()),
        docs.dictionary.take(pa.array(np.where(n > 0, first >> 32, 0))), pa.array(first & 0xFFFFFFFF), pa.array(beside),
    ]
    found = pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _COUNTED.split(", ")])
    return found.filter(pa.array(n > 0))


def _counted(confidence: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not len(batch):
                continue
            batch = batch if left is None else pa.concat_batches([left, batch])
            ids = batch["doc_id"]
            # The last document may go on in the next batch.
            own = pc.index(pc.equal(ids, ids[-1]) if ids[-1].is_valid else ids.is_null(), True).as_py()
            left = batch.slice(own)
            if own:
                yield _spellings(batch.slice(0, own), confidence)
        if left is not None:
            yield _spellings(left, confidence)

    return run


def entries_of_texts(texts: DataFrame, confidence: Callable[[np.ndarray, np.ndarray], np.ndarray], docs: int, share: float, least: int = LEAST_COUNT) -> DataFrame:
    """``entries`` of whole documents (doc_id, text; all rows of a document in one task), where the ordinary words are those in
    at least ``share`` of all ``docs`` documents (``widespread``). ``confidence`` gives that of words by doc_id and place.

    Words are counted as arrays where their texts lie, at once for spellings and for documents; each task sends a row a spelling.
    """
    counted = texts.select(F.col("doc_id").cast("long"), "text").sortWithinPartitions("doc_id").mapInArrow(_counted(confidence), _COUNTED)
    # All follows one shuffle.
    spelled = counted.repartition("key").groupBy("key", "form").agg(
        F.sum("n").alias("n"), F.sum("confidence").alias("confidence"), F.min("doc").alias("doc"), F.min_by("pos", "doc").alias("pos"), F.sum("docs").alias("docs"),
    )
    term = (F.length("form") >= 3) & F.col("form").rlike(r"\p{L}")
    spelled = spelled.withColumns({c: F.when(term, F.col(c)) for c in ("n", "confidence", "doc", "pos")})
    keyed = spelled.groupBy("key").agg(
        F.max_by("form", F.when(F.col("n").isNotNull(), F.struct("n", -F.col("doc"), -F.col("pos")))).alias("term"), F.sum("n").alias("count"),
        (F.sum("confidence") / F.sum("n")).alias("mean_confidence"), (F.sum("docs") >= share * docs).alias("known"),
    )
    return _worth_a_look(keyed, least)


def impact(count: Column, archaic: Column, proper: Column, mean: Column, corroborated: Column | None = None) -> Column:
    d = 1 + 0.8 * F.least(F.lit(1), archaic) + 0.6 * proper.cast("int") + (100 - mean) / 100
    if corroborated is not None:
        d = d + 1.5 * corroborated.cast("int")
    return F.floor(d * d * F.log2(1 + count) * 100 + 0.5) / 100


def _pairs(found: DataFrame, *beside: str) -> DataFrame:
    """a, b of ``neighbours``, each with its key and the columns ``beside``.

    Strings are several times the keys, which Spark can't know beforehand: neither side may be sent whole to all.
    """
    at = F.sequence(F.lit(2), F.length("key"))
    without = F.transform(at, lambda k: F.concat(F.substr("key", F.lit(1), k - 1), F.substr("key", k + 1)))
    forms_ = F.array_distinct(F.concat(F.array("key"), F.when(F.length("key") > 1, without).otherwise(F.array().cast("array<string>"))))
    a = found.select(F.struct("key", *beside).alias("a"), F.explode(forms_).alias("form"))
    b = a.withColumnRenamed("a", "b")
    return a.join(b.hint("merge"), "form").where("a.key < b.key").select("a", "b").distinct().where(edit_distance(F.col("a.key"), F.col("b.key")) <= 1)


def neighbours(found: DataFrame) -> DataFrame:
    """Pairs of keys one edit apart that share their first letter (a, b with a < b).

    Such keys are equal after at most one letter is dropped from each, so they meet on one of those strings: no key is
    compared with all others of its letter.
    """
    return _pairs(found).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"))


def leaders(found: DataFrame) -> DataFrame:
    """key, home: each key's leader (itself, if it is one).

    In order of count, a key becomes a leader unless one edit away from an earlier leader, whose variant it then is: the
    first of them. In each round keys that no earlier one may still lead become leaders, and what they lead its variants;
    the next round has only what is left, till nothing is.
    """
    key = lambda c: F.col(c).alias("key")
    first = F.col("a.count") >= F.col("b.count")  # of two counts alike the key that sorts first, a, is the earlier
    earlier, other = (F.when(first, F.col(x)).otherwise(F.col(y)) for x, y in ("ab", "ba"))
    before = _pairs(found, "count").select(other.alias("a"), earlier.alias("b")).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), F.col("b.count").alias("n"))
    before = keep(before)
    open_, edges, told = found.select("key"), before.select("a", "b"), []
    while True:
        told.append(keep(open_.join(edges.select(key("a")), "key", "left_anti")))
        variants = edges.join(told[-1].select(F.col("key").alias("b")), "b", "left_semi").select(key("a"))
        left = keep(edges.select(key("a")).distinct().join(variants, "key", "left_anti"))
        if len(told) > 1:
            drop(open_)
        if left.isEmpty():
            break
        rest_ = edges.join(left.select(F.col("key").alias("a")), "a", "left_semi").join(left.select(F.col("key").alias("b")), "b", "left_semi")
        old, open_, edges = edges, left, keep(rest_.select("a", "b"))
        if len(told) > 1:
            drop(old)
    lead = reduce(DataFrame.union, told)
    led = before.join(lead.select(F.col("key").alias("b")), "b").groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), "b")).alias("home"))
    return led.select(key("a"), "home").union(lead.select("key", F.col("key").alias("home")))


def fold_variants(found: DataFrame) -> DataFrame:
    """Leaders with their variants' counts and signals; spelling, age and kind stay the leader's own."""
    found = keep(found)  # else all words would be counted again each time that it is read
    own = found.join(leaders(found), "key").withColumn("is_leader", F.col("key") == F.col("home"))
    order = F.struct((~F.col("is_leader")).alias("l"), (-F.col("count")).alias("n"), "key")
    rows = own.groupBy("home").agg(
        F.sum("count").alias("count"), (F.sum(F.col("mean_confidence") * F.col("count")) / F.sum("count")).alias("mean_confidence"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), "term", "signals", "archaic", "proper"))).alias("m"),
    )
    head = F.element_at("m", 1)
    return rows.select(
        F.col("home").alias("key"), head["term"].alias("term"), "count", "mean_confidence", head["archaic"].alias("archaic"), head["proper"].alias("proper"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["signals"]))).alias("signals"), F.transform(rest(F.col("m")), lambda x: x["term"]).alias("variants"),
    )


def top(folded: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The ``limit`` terms that matter most."""
    scored = folded.withColumn("impact", impact(F.col("count"), F.col("archaic"), F.col("proper"), F.col("mean_confidence")))
    return scored.orderBy(F.desc("impact"), F.desc("count"), "key").limit(limit)


def vet(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``found`` (term, ...) after a reader's verdicts (term, decision, correction): accepted unless ignored; a
    correction that is blank or the same accepts."""
    joined = found.join(verdicts, "term", "left").where(F.coalesce("decision", F.lit("accept")) != "ignore")
    new = F.when((F.col("decision") == "correct") & (F.trim("correction") != "") & (F.trim("correction") != F.col("term")), F.trim("correction"))
    return joined.withColumn("from_term", F.when(new.isNotNull(), F.col("term"))).withColumn("term", F.coalesce(new, "term")).drop("decision", "correction")


def widespread(tokens: DataFrame, docs: int, share: float) -> DataFrame:
    """Ordinary words by rule: those in at least ``share`` of all documents."""
    each = tokens.select("doc_id", "token").distinct()  # so that a word is brought to its form once a document
    seen = each.select("doc_id", F.lower(normalize_token(F.col("token"))).alias("word")).distinct()
    return seen.groupBy("word").count().where(F.col("count") >= share * docs).select("word")
