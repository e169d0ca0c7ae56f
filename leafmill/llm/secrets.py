"""Secrets in texts: three fixed patterns, and strings that a Markov model holds for random.

Two character Markov models, of random strings and of ordinary identifiers, give each token of 12 or more signs with a
letter in it a log-likelihood ratio. They are trained from samples that the patterns label: what the patterns find is
random, and the different identifiers of 8 or more signs that occur twice or more in what is left of all documents are
ordinary, so that both samples grow with the input. Bigrams of either are counted by map-side aggregates over the alphabet's pairs. A pair's probability
backs off to the single character's; the random model is half that and half even over the alphabet, as found secrets
may all be of one kind. A token that is no part of a pattern's match is a secret when its ratio is at least
``least_ratio`` in all and ``least_each`` a character. Numbers without a letter aren't scored.

Positions are code points. Matches are found without overlap from the left, per kind; rows are independent of each other
but for the model; repeated rows get equal results; null and empty texts have no matches, long ones are read whole; an
empty table gives none; other columns aren't read. All is column expressions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
TOKEN = r"[A-Za-z0-9+/_-]{12,}={0,2}"
WORD = r"[A-Za-z0-9+/_-]{8,}"
ALPHABET = string.ascii_letters + string.digits + "+/_.=-"


def _cut(text: Column, pattern: str, hint: Column, group: int = 0) -> Column:
    """Array of (gap before, length, value) of the matches; the text between matches is what split() leaves."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s))
    both = F.arrays_zip(gaps.alias("gap"), F.transform(whole, lambda s: F.length(s)).alias("size"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    return F.when(hint, both)


def _hits(docs: DataFrame) -> DataFrame:
    """uid, doc_id, kind, start, stop, value: one row a match, and one without a kind for a document without any."""
    text = F.coalesce("text", F.lit(""))
    cuts = {
        "assign": _cut(text, ASSIGN, text.rlike(ASSIGN_HINT), 2),
        "access": _cut(text, ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": _cut(text, HEX, text.rlike(HEX)),
        "token": _cut(text, TOKEN, text.rlike(TOKEN)),
    }
    none = F.array().cast("array<struct<gap:int,size:int,value:string>>")

    def tagged(kind: str) -> Column:
        fields = ("gap", "size", "value")
        return F.transform(F.coalesce(cuts[kind], none), lambda m: F.struct(F.lit(kind).alias("kind"), *(m[f].alias(f) for f in fields)))

    hits = F.concat(*map(tagged, cuts))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", hits.alias("hits"))
    return rows.select("uid", "doc_id", F.posexplode_outer("hits").alias("pos", "hit")).select("uid", "doc_id", "pos", "hit.*")


def _placed(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy("uid", "kind").orderBy("pos")
    stop = F.sum(F.coalesce(F.col("gap"), F.lit(0)) + F.coalesce(F.col("size"), F.lit(0))).over(order)
    return hits.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size")).where("kind is null or size is not null")


def bigrams(values: DataFrame) -> DataFrame:
    """The characters of each ``value`` and what comes before them (nothing before the first)."""
    signs = values.where(F.length("value") > 0).withColumn("_b", F.split("value", ""))
    before = F.slice(F.concat(F.array(F.lit("")), "_b"), F.lit(1), F.size("_b"))
    return signs.select(*values.columns, F.inline(F.arrays_zip(before.alias("a"), F.col("_b").alias("b"))))


def ordinary(docs: DataFrame) -> DataFrame:
    """value: the different identifiers that occur twice or more in all documents outside of the patterns' matches.

    One that occurs once could be the secret that is looked for, and would teach the model its own pairs."""
    text = F.coalesce("text", F.lit(""))
    found = f"{ASSIGN}|{ACCESS}|{HEX}"
    left = F.when(text.rlike(f"{ASSIGN_HINT}|{ACCESS}|{HEX}"), F.regexp_replace(text, found, " ")).otherwise(text)
    return docs.select(F.explode(F.regexp_extract_all(left, F.lit(WORD), F.lit(0))).alias("value")).groupBy("value").count().where("count > 1").select("value")


def train(randoms: DataFrame, words: DataFrame, strength: float = 10.0, random_prior: float = 1.0, word_prior: float = 0.1) -> DataFrame:
    """a, b, ratio: ln P(b | a) under the random less under the ordinary model, of samples (value) of both.

    A pair's probability backs off to the single character's with ``strength`` counts, and that to the prior; ``a`` is
    empty at a value's start. The table has a row for each pair of the alphabet, whatever the samples' size.
    """
    n = len(ALPHABET)
    count = lambda values, c: bigrams(values.select("value")).groupBy("a", "b").agg(F.count("*").alias(c))
    signs = F.array(*map(F.lit, ALPHABET))
    every = words.sparkSession.range(1).select(F.explode(F.concat(F.array(F.lit("")), signs)).alias("a")).select("a", F.explode(signs).alias("b"))
    counts = every.join(count(randoms, "r"), ["a", "b"], "left").join(count(words, "w"), ["a", "b"], "left").fillna(0)

    def model(c: str, prior: float) -> Column:
        of = lambda *keys: F.sum(c).over(Window.partitionBy(*keys))  # noqa: E731  over the alphabet's pairs only
        single = (of("b") + prior) / (of(F.lit(0)) + prior * n)
        return (F.col(c) + strength * single) / (of("a") + strength)

    return counts.select("a", "b", (F.log((model("r", random_prior) + 1 / n) / 2) - F.log(model("w", word_prior))).alias("ratio"))


def _id() -> Column:
    """A value's name: a long value's own text isn't carried with each of its pairs."""
    return F.struct(F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(1), "value").alias("h2")).alias("id")


def score(tokens: DataFrame, model: DataFrame) -> DataFrame:
    """id, n (characters), ratio of each distinct value."""
    pairs = bigrams(tokens.select("value", _id()).dropDuplicates(["id"])).select("id", "a", "b")
    scored = pairs.join(F.broadcast(model), ["a", "b"], "left")  # the alphabet's pairs
    return scored.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.coalesce("ratio", F.lit(0.0))).alias("ratio"))


def find_secrets(docs: DataFrame, least_ratio: float = 15.0, least_each: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """uid (one a row of docs), doc_id, kind, start, stop, value of every secret; kind is null for rows without."""
    scratch = scratch or Scratch(docs.sparkSession)
    hits = scratch.keep(_placed(_hits(docs)), "hits")
    base = hits.where("kind in ('access', 'hex') or kind = 'assign' and length(value) >= 12")
    randoms = base.where(F.regexp_like("value", F.lit("[0-9]"))).select("value").distinct()
    model = scratch.keep(train(randoms, ordinary(docs)), "model")
    tokens = hits.where(F.col("kind") == "token").where(F.regexp_like("value", F.lit("[A-Za-z]")))
    good = score(tokens, model).where((F.col("ratio") >= least_ratio) & (F.col("ratio") >= least_each * F.col("n"))).select("id")
    b = base.select(F.col("uid").alias("u"), F.col("start").alias("s"), F.col("stop").alias("t"))
    overlap = (F.col("uid") == F.col("u")) & (F.col("start") < F.col("t")) & (F.col("s") < F.col("stop"))
    found = tokens.withColumn("id", _id()).join(good, "id", "left_semi").join(b, overlap, "left_anti").withColumn("kind", F.lit("markov"))
    cols = ["uid", "doc_id", "kind", "start", "stop", "value"]
    every = base.select(cols).union(found.select(cols))
    lone = hits.groupBy("uid").agg(F.first("doc_id").alias("doc_id")).join(every.select("uid"), "uid", "left_anti")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("start", "long"), ("stop", "long"), ("value", "string"))]
    return every.union(lone.select("uid", "doc_id", *none))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of the documents."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "stop").alias("s")))
    rows = found.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(k) + 1)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: s["s"]), ",")
    base = F.filter("spans", lambda s: s["rank"] < 4)
    return rows.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
