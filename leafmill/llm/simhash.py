"""SimHash fingerprints of documents, and the search for fingerprints within a Hamming radius.

Terms are pairs of neighbouring words (single words where a text has but one), weighted by 1 + ln(count). Each term's
hash votes with its weight for or against each bit. Two fingerprints' likeness is the share of equal bits. The search
splits fingerprints into blocks, so many that within radius r at least one block differs in no more than ``flips`` bits.
Fingerprints stand in one table a block; a query looks up each value of a block that is so near its own, which finds
every match. The radius is that of real near copies: see the README.

No side of a join is broadcast: all grow with the documents. Null and empty texts have the fingerprint of no votes (all
zero), very long ones are read whole. Rows with equal ids are ordered by their text's hash, null ids come last; equal
texts have equal fingerprints; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, partitions, texts

BITS, RADIUS = 128, 20
_SECOND = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word to 64-bit hash; emptied when it has grown to ``most`` words, so that its memory has a bound."""

    most = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def fingerprint(hashes: np.ndarray) -> bytes:
    """BITS bits, of the hashes of a text's words in order."""
    if not len(hashes):
        return bytes(BITS // 8)
    terms = mix(hashes[:-1] * np.uint64(3) + hashes[1:]) if len(hashes) > 1 else hashes
    terms, counts = np.unique(terms, return_counts=True)
    both = np.stack([terms, mix(terms ^ _SECOND)], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(terms), BITS // 8), axis=1)
    weights = (1 + np.log(counts)).astype(np.float32)
    return np.packbits(2 * (weights @ bits.astype(np.float32)) > weights.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third of code points replaced by as many first ones of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (binary) of every whole text."""

    def run(batches):
        words = Words()
        for batch in batches:
            out = [fingerprint(words.of(t)) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint binary")


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, tail, bucket in buckets of consecutive ids, each with the rows that follow its last as ``tail``.

    Bounds are ids that occur, one per shuffle partition; texts are shuffled once and only a bound's rows twice.
    """
    n = partitions(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    at = F.array(*[F.lit(k / n) for k in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    bounds, top = docs.agg(F.percentile_approx("doc_id", at, 10_000), F.max("doc_id")).first()
    bounds = sorted(set(bounds or []) - {top})
    literal = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<long>")
    own = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(literal, lambda b: b < F.col("doc_id"))))
    is_bound = F.array_contains(literal, F.col("doc_id"))
    copies = F.array(F.struct(own.alias("bucket"), F.lit(False).alias("tail")))
    copies = F.when(F.coalesce(is_bound, F.lit(False)), F.array_append(copies, F.struct((own + 1).alias("bucket"), F.lit(True).alias("tail")))).otherwise(copies)
    copies = F.when(F.col("doc_id").eqNullSafe(F.lit(top)), F.array_append(copies, F.struct(F.lit(0).alias("bucket"), F.lit(True).alias("tail")))).otherwise(copies)
    return (
        docs.select("doc_id", "text", F.inline(copies))
        .repartitionById(n, F.col("bucket"))
        .sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    )


def edit_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's edited text takes its last third from the next document in descending id order (the last from the
    first). A sole document follows itself.
    """
    import hashlib

    def run(batches):
        words, last, out = Words(), None, []

        def close(now):
            key, text, own, _ = last
            edited = edited_text(text, now[1])
            changed = fingerprint(words.of(edited)) if edited != text else own
            return (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, now[2]))

        for batch in batches:
            for key, text, bucket, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "tail"))):
                if last is None and tail:
                    continue  # a further row of the id that closed the bucket
                now = (key, text, fingerprint(words.of(text)), bucket)
                if last is not None:
                    out.append(close(now))
                last = None if tail else now
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * 7, fields)], schema=fields)
            out = []

    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = pa.schema(
        [("doc_id", to_arrow_type(kind)), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
        + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )
    return neighbours(docs).mapInArrow(
        run,
        f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def _blocks(radius: int, flips: int) -> list[tuple[int, int]]:
    """First bit and width of each block: if all differed in more than ``flips`` bits, that would exceed the radius."""
    n = max(3, radius // (flips + 1) + 1)
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _halves(prints: DataFrame, side: str) -> DataFrame:
    """The different fingerprints as two longs each."""
    half = lambda k: F.conv(F.hex(F.substring("fingerprint", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"{side}{k}")
    return prints.select("fingerprint").distinct().select(half(0), half(1))


def _whole(side: str) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(f"{side}{k}"), 16, "0") for k in range(2)]))


def _row(t: int, value: Column, x: Column) -> Column:
    return F.struct(F.lit(t).alias("t"), value.bitwiseXOR(x).alias("key"))


def _tables(halves: DataFrame, side: str, radius: int, flips: int, near: bool) -> DataFrame:
    """t, key and the fingerprint: key is the value of block t, or with ``near`` each value within ``flips`` of it."""
    high, low = F.col(f"{side}0"), F.col(f"{side}1")
    rows = []
    for t, (at, width) in enumerate(_blocks(radius, flips)):
        end = at + width
        if end <= 64:
            value = F.shiftrightunsigned(high, 64 - end)
        elif at >= 64:
            value = F.shiftrightunsigned(low, 128 - end)
        else:
            value = F.shiftleft(high, end - 64).bitwiseOR(F.shiftrightunsigned(low, 128 - end))
        value = value.bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        masks = [sum(1 << b for b in bits) for n in range(flips + 1 if near else 1) for bits in combinations(range(width), n)]
        masks = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")
        rows.append(F.transform(masks, partial(_row, t, value)))
    return halves.select(high, low, F.inline(F.concat(*rows)))


def _near(queries: DataFrame, prints: DataFrame, radius: int, flips: int) -> DataFrame:
    """q, d, distance of the different fingerprints within ``radius`` of each other; itself is one of them."""
    distance = sum((F.bit_count(F.col(f"q{k}").bitwiseXOR(F.col(f"d{k}"))) for k in range(2)), F.lit(0))
    q = _tables(_halves(queries, "q"), "q", radius, flips, True)
    d = _tables(_halves(prints, "d"), "d", radius, flips, False)
    found = q.join(d.hint("merge"), ["t", "key"]).where(distance <= radius).select("q0", "q1", "d0", "d1").distinct()
    return found.select(_whole("q").alias("q"), _whole("d").alias("d"), distance.alias("distance"))


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, flips: int = 2) -> DataFrame:
    """query_id, doc_id, distance of all fingerprints within ``radius`` of each query's, itself left out."""
    q = queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("q"))
    d = prints.select("doc_id", F.col("fingerprint").alias("d"))
    found = _near(queries, prints, radius, flips).join(q.hint("merge"), "q").join(d.hint("merge"), "d")
    return found.where(~F.col("query_id").eqNullSafe(F.col("doc_id"))).select("query_id", "doc_id", "distance")


def counts_within(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, flips: int = 2) -> DataFrame:
    """fingerprint, n: how many documents are within ``radius`` of each query's fingerprint, itself among them.

    Equal fingerprints are one row with a count, so copies are never written out as pairs.
    """
    copies = prints.groupBy(F.col("fingerprint").alias("d")).agg(F.count("*").alias("copies"))
    return _near(queries, prints, radius, flips).join(copies.hint("merge"), "d").groupBy(F.col("q").alias("fingerprint")).agg(F.sum("copies").alias("n"))


def fingerprint_report(docs: DataFrame, radius: int = RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """``edit_likeness`` of all documents, and n_within of those whose id is divisible by 100 (null for others): the
    other documents whose fingerprint is within ``radius`` of theirs."""
    scratch = scratch or Scratch(docs.sparkSession)
    likeness_ = scratch.keep(edit_likeness(docs), "likeness")
    prints = likeness_.select("doc_id", F.unhex("fingerprint").alias("fingerprint"))
    asked = F.col("doc_id") % 100 == 0
    counts = counts_within(prints.where(asked), prints, radius).select(F.lower(F.hex("fingerprint")).alias("fingerprint"), "n")
    queries = likeness_.where(asked).join(counts.hint("merge"), "fingerprint").withColumn("n_within", F.col("n") - 1)
    rest = likeness_.where(~F.coalesce(asked, F.lit(False))).withColumn("n_within", F.lit(None).cast("long"))
    return queries.select(*likeness_.columns, "n_within").union(rest)
