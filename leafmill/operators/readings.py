"""Two readings of a text: which words one of them lacks, where, and how they are put back.

A reading that only lacks words is cut at those that can stand in one place alone; another one where both have a run of
words once each, along the longest chain of such places that don't cross. Only stretches between that differ are aligned,
with as few words left out as can be, then as few changed marks, then as few gaps, each gap as far up as equal words allow.
Words count without case and marks.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a left-out word, changed marks and a new gap cost: each outweighs any number of the next.
WORD, MARK, GAP = 1 << 42, 1 << 21, 1
_NEVER = 1 << 62


def plain(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"[^\p{L}\p{N}_]", ""))


# ---- one stretch ----------------------------------------------------------------------------------------------------


def _rows(own: np.ndarray, other: np.ndarray, marks: tuple[np.ndarray, np.ndarray], at: int, to: int, first: tuple) -> Iterator[tuple]:
    """Costs (after a shared or added word, after a left-out one) of rows ``at`` + 1 to ``to``, from row ``at``'s."""
    kept, gone = first
    for i in range(at, to):
        best = np.minimum(kept, gone)
        met = np.full(len(kept), _NEVER)
        met[1:] = np.where(other == own[i], best[:-1] + MARK * (marks[1] != marks[0][i]), _NEVER)
        gone = np.minimum(np.minimum(gone, kept + GAP) + WORD, _NEVER)
        met[1:] = np.minimum(met[1:], gone[:-1])
        kept = np.minimum(np.minimum.accumulate(met), _NEVER)
        yield kept, gone


def left_out(own: list[str], other: list[str], own_raw: list[str] | None = None, other_raw: list[str] | None = None) -> list[tuple[int, int, int]]:
    """(start, n, at) of the runs of ``own`` that ``other`` lacks, ``at`` being how many of its words come before.

    Memory is of the order of the square root of one side times the other: of all rows of costs only each so many are
    kept, and those between them made again on the way back.
    """
    own_raw, other_raw = own_raw or own, other_raw or other
    head = 0
    while head < min(len(own), len(other)) and own_raw[head] == other_raw[head]:
        head += 1
    tail = 0
    while tail < min(len(own), len(other)) - head and own_raw[-1 - tail] == other_raw[-1 - tail]:
        tail += 1
    number: dict[str, int] = {}
    ids = lambda ws, upto: np.array([number.setdefault(w, len(number)) for w in ws[head : len(ws) - upto]], np.int64)
    if head + tail == len(other):
        return [(head, len(own) - len(other), head)] if len(own) > len(other) else []
    a, b = ids(own, tail), ids(other, tail)
    marks = ids(own_raw, tail), ids(other_raw, tail)
    n, m = len(a), len(b)
    step = max(1, int(n**0.5))
    saved = {0: (np.zeros(m + 1, np.int64), np.full(m + 1, _NEVER))}
    for i, row in enumerate(_rows(a, b, marks, 0, n, saved[0]), 1):
        if i % step == 0:
            saved[i] = row
    gone = np.zeros(len(own), bool)
    before = np.zeros(len(own), np.int64)
    i, j, low, rows, out = n, m, n + 1, [], None
    while i:
        if i <= low:
            low = (i - 1) // step * step
            rows = [saved[low], *_rows(a, b, marks, low, i, saved[low])]
        kept, lost = rows[i - low]
        if out is None:
            out = lost[j] < kept[j]
        if out:
            gone[head + i - 1], before[head + i - 1] = True, head + j
            up_kept, up_lost = rows[i - 1 - low]
            out = bool(up_lost[j] <= up_kept[j] + GAP)
            i -= 1
            continue
        up = np.minimum(*rows[i - 1 - low])
        if j and a[i - 1] == b[j - 1] and up[j - 1] + MARK * (marks[0][i - 1] != marks[1][j - 1]) == kept[j]:
            out = bool(rows[i - 1 - low][1][j - 1] < rows[i - 1 - low][0][j - 1])
            i, j = i - 1, j - 1
        else:
            out = bool(lost[j - 1] < kept[j - 1] or kept[j - 1] >= _NEVER)
            j -= 1
    runs, k = [], 0
    while k < len(own):
        if not gone[k]:
            k += 1
            continue
        to = k
        while to < len(own) and gone[to] and before[to] == before[k]:
            to += 1
        runs.append((k, to - k, int(before[k])))
        k = to
    return runs


def settled(own: list[str], other: list[str], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``runs`` of a whole text, each as far up as equal words let it move, and two as one where they can meet.

    A gap may move past words that it begins or ends with too, which changes nothing of what is left. A word lost at the
    end of its repetitions and others lost right behind it are found as two gaps if each is at its own upper end.
    """
    out: list[tuple[int, int, int]] = []
    for start, n, at in runs:
        floor = out[-1][0] + out[-1][1] if out else 0
        while start > floor and at > 0 and own[start - 1] == own[start + n - 1] == other[at - 1]:
            start, at = start - 1, at - 1
        if out:
            s, k, t = out[-1]
            by = 0
            while s + k + by < start and t + by < len(other) and own[s + by] == own[s + k + by] == other[t + by]:
                by += 1
            if s + k + by == start and t + by == at:
                out[-1] = (s + by, k + n, t + by)
                continue
        out.append((start, n, at))
    return out


# ---- whole readings -------------------------------------------------------------------------------------------------


@lru_cache(1 << 16)
def _bare(token: str) -> str:
    """``plain`` of one word."""
    return "".join(c for c in token if c == "_" or unicodedata.category(c)[0] in "LN").lower()


def _earliest(own: list[str], other: list[str], ahead: int = 64) -> list[int]:
    """Where each word of ``other`` is in ``own`` if it is taken as early as can be; a stretch of words alike is taken at once."""
    out, k, b = [], 0, 0
    while b < len(other):
        some = other[b : b + ahead]
        if own[k : k + len(some)] == some:
            out += range(k, k := k + len(some))
        else:
            for w in some:
                out.append(k := own.index(w, k))
                k += 1
        b += len(some)
    return out


def _forced(own: list[str], other: list[str]) -> np.ndarray | None:
    try:
        first = np.array(_earliest(own, other), np.int64)
    except ValueError:
        return None
    last = len(own) - 1 - np.array(_earliest(own[::-1], other[::-1]), np.int64)[::-1]
    b = np.flatnonzero(first == last)
    return np.stack([first[b], b], 1)


def forced(own: list[str], other: list[str]) -> list[tuple[int, int]] | None:
    """(a, b) of the words b of ``other`` that can only be word a of ``own``; None if ``other`` doesn't only lack words.

    These are the words that have one place whether all are taken as early or as late as can be.
    """
    places = _forced(own, other)
    return None if places is None else [(a, b) for a, b in places.tolist()]


def rising(values: list[int]) -> list[int]:
    """Where the longest rising chain of ``values`` has its members."""
    ends, at, back = [], [], []
    for k, v in enumerate(values):
        i = bisect_left(ends, v)
        back.append(at[i - 1] if i else -1)
        if i == len(ends):
            ends.append(v)
            at.append(k)
        else:
            ends[i], at[i] = v, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def anchors(own: list[str], other: list[str], n: int = 3) -> list[tuple[int, int]]:
    """(a, b): places of runs of ``n`` words that both readings have once and with the same marks, on the longest chain that
    doesn't cross. Where only marks differ the alignment decides: words beside a gap are often the same but for these."""

    def once(words: list[str]) -> dict[tuple[str, ...], int]:
        at: dict[tuple[str, ...], int] = {}
        bare = [_bare(w) for w in words]
        for k, run in enumerate(zip(*(bare[i:] for i in range(n)))):
            at[run] = -1 if run in at else k
        return at

    there = once(other)
    both = [(a, b) for run, a in once(own).items() if a >= 0 and (b := there.get(run, -1)) >= 0 and own[a : a + n] == other[b : b + n]]
    return [both[k] for k in rising([b for _, b in both])]


def lacking(own: list[str], other: list[str]) -> list[tuple[int, int, int]]:
    """(start, n, at) of the runs of a whole text that ``other`` lacks."""
    if own == other:
        return []
    places = _forced(own, other)
    between = np.array(anchors(own, other), np.int64).reshape(-1, 2) if places is None else places
    cuts = np.concatenate([[(0, 0)], between, [(len(own), len(other))]])
    steps = np.diff(cuts, axis=0)
    steps[0] = 0  # the two words at the start needn't be alike, at all other cuts they are
    some = np.flatnonzero((steps != 1).any(1))
    runs = []
    for (a, b), (c, d) in zip(cuts[some].tolist(), cuts[some + 1].tolist()):
        x, y = own[a:c], other[b:d]
        if x != y and x:
            bare = ([_bare(w) for w in x], [_bare(w) for w in y]) if places is None else (x, y)
            runs += [(a + start, k, b + at) for start, k, at in left_out(*bare, x, y)]
    return settled(own, other, runs)


_RUNS = T.ArrayType(T.StructType().add("start", T.LongType()).add("n", T.IntegerType()).add("at", T.LongType()))


def _words(column: pa.ListArray) -> Iterator[list[str]]:
    """The words of each row, an empty list for null; those of one row at a time are Python's."""
    ends = column.offsets.to_pylist()
    for a, z in zip(ends, ends[1:]):
        yield column.values.slice(a, z - a).to_numpy(zero_copy_only=False).tolist()


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [lacking(own, other) for own, other in zip(_words(batch["own"]), _words(batch["other"]))]
        runs = np.array([r for rs in found for r in rs], np.int64).reshape(-1, 3)
        each = pa.StructArray.from_arrays([pa.array(runs[:, 0] + 1), pa.array(runs[:, 1].astype(np.int32)), pa.array(runs[:, 2])], ["start", "n", "at"])
        ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, each)], [*batch.schema.names, "runs"])


def aligned(sides: DataFrame) -> DataFrame:
    """``sides`` (doc_id, own, other and more; arrays of words) with runs: start, n, at of the runs of ``own`` that ``other``
    lacks, and how many of its words come before. Words are numbered from 1."""
    return sides.mapInArrow(_aligned, T.StructType([*sides.schema, T.StructField("runs", _RUNS)]))


def _lists(side: DataFrame, *names: str) -> DataFrame:
    """doc_id and each of ``names`` as an array in the words' order."""
    listed = side.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), *names))).alias("l"))
    return listed.select("doc_id", *(F.col(f"l.{n}").alias(n) for n in names))


def _both(tokens: DataFrame, reading: DataFrame) -> DataFrame:
    """doc_id, own, other (null without a second reading), and confidence and id where the tokens have these: arrays, a row a document."""
    own = _lists(tokens, "token", *(c for c in _BESIDE if c in tokens.columns)).withColumnRenamed("token", "own")
    # own names for the second side's columns: both sides may come from one frame, whose columns a join would confuse
    other = _lists(reading.select(*(F.col(c).alias(c) for c in ("doc_id", "pos", "token"))), "token").withColumnRenamed("token", "other")
    return own.join(other, "doc_id", "left")


def missing_runs(tokens: DataFrame, reading: DataFrame) -> DataFrame:
    """doc_id, start, n, at: the runs of each document's tokens (doc_id, pos, token) that a second reading of it lacks, and
    how many of its words come before. Both are numbered from 1, each on its own."""
    return aligned(_both(tokens, reading).select("doc_id", "own", "other")).select("doc_id", F.inline("runs"))


def lost_totals(places: DataFrame, cell: int = 40, least: int = 2) -> DataFrame:
    """doc_id, n_words: how many words a second reading whose words are known by their places lacks (doc_id, own, other; arrays
    of places from 1), without those of a stretch of ``cell`` places that lacks fewer than ``least``.

    Words alone don't tell: what is lost of "a a b b c c" can be one word and two, or all three in one place.
    """
    lost = places.select("doc_id", F.explode(F.array_except("own", "other")).alias("p"))
    cells = lost.groupBy("doc_id", F.floor((F.col("p") - 1) / cell).alias("cell")).agg(F.count("*").alias("n"))
    return cells.where(F.col("n") >= least).groupBy("doc_id").agg(F.sum("n").alias("n_words"))


_BESIDE = ("confidence", "id")


def _part(l: Column, first: Column, to: Column) -> Column:
    """Elements ``first`` to ``to`` of ``l``; in a lambda, ``slice`` would copy all of it each time."""
    places = F.filter(F.sequence(first, F.greatest(first, to)), lambda k: k <= to)
    return F.transform(places, lambda k: F.get(l, (k - 1).cast("int")))


def _described(found: DataFrame, strong: int, near: int) -> DataFrame:
    """The runs of ``aligned`` sides, a row a run."""
    more = [c for c in _BESIDE if c in found.columns]
    said = lambda words: F.array_join(words, " ")
    other = F.col("other")

    def row(r: Column) -> Column:
        here = lambda c: _part(F.col(c), r["start"], r["start"] + r["n"] - 1)
        sure = lambda: F.filter(F.transform(here("confidence"), lambda c: c.cast("double")), lambda c: c.isNotNull())
        mean = lambda: F.try_divide(F.aggregate(sure(), F.lit(0.0), lambda s, c: s + c), F.size(sure()))
        beside = {"confidence": lambda: mean().alias("confidence"), "id": lambda: here("id").alias("ids")}
        return F.struct(
            *(r[c].alias(c) for c in ("start", "n", "at")), said(here("own")).alias("words"), F.when(r["n"] >= strong, "strong").otherwise("weak").alias("strength"),
            said(_part(other, F.greatest(F.lit(1), r["at"] - near + 1), r["at"])).alias("before"), said(_part(other, r["at"] + 1, r["at"] + near)).alias("after"), *(beside[c]() for c in more),
        )

    return found.select("doc_id", F.inline(F.transform("runs", row)))


def described(runs: DataFrame, tokens: DataFrame, reading: DataFrame, strong: int = 4, near: int = 3) -> DataFrame:
    """``runs`` with words, confidence and ids (where the tokens have these), strength, and the words of the reading right
    before and after, as they stand there, between which the run belongs."""
    each = runs.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), "n", F.col("at").cast("long").alias("at"))).alias("runs"))
    return _described(each.join(_both(tokens, reading), "doc_id"), strong, near)


def compare_lists(sides: DataFrame, least: int = 2, strong: int = 4, sure: float = 60, near: int = 3) -> DataFrame:
    """``compare_readings`` of documents whose words are arrays (doc_id, own, other; confidence and id beside own): no word is
    shuffled or sorted, and what a document's alignment has found is described as it comes back."""
    found = aligned(sides).withColumn("runs", F.filter("runs", lambda r: r["n"] >= least))
    found = _described(found, strong, near)
    return found.where(F.col("confidence") >= sure) if "confidence" in found.columns else found


def compare_readings(tokens: DataFrame, reading: DataFrame, least: int = 2, strong: int = 4, sure: float = 60) -> DataFrame:
    """The described runs of at least ``least`` words that a second reading lacks; where tokens have a confidence, only
    those of a mean of at least ``sure``."""
    return compare_lists(_both(tokens, reading), least, strong, sure)


def restored(found: DataFrame) -> DataFrame:
    """``aligned`` sides with whole: the second reading's words with those of the runs put back, an array."""

    def piece(r: Column, k: Column) -> Column:
        after = F.coalesce(F.get(F.col("runs"), k - 1)["at"], F.lit(0))
        return F.concat(_part(F.col("other"), after + 1, r["at"]), _part(F.col("own"), r["start"], r["start"] + r["n"] - 1))

    last = F.coalesce(F.get("runs", F.size("runs") - 1)["at"], F.lit(0))
    rest = F.slice("other", (last + 1).cast("int"), F.size("other"))
    return found.withColumn("whole", F.concat(F.flatten(F.transform("runs", piece)), F.coalesce(rest, F.array().cast("array<string>"))))


def put_back(reading: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, pos, token, added: the reading with the words of runs (doc_id, at, words) behind its first ``at`` words.

    All runs of a document go in at once, by sorting; what a word carries (its emphasis) moves with its row.
    """
    new = runs.select("doc_id", F.col("at").alias("p"), F.posexplode(F.split("words", " ")).alias("k", "token")).withColumn("added", F.lit(True))
    old = reading.select("doc_id", F.col("pos").cast("long").alias("p"), F.lit(-1).alias("k"), "token", F.lit(False).alias("added"))
    order = Window.partitionBy("doc_id").orderBy("p", "k")
    return old.unionByName(new).select("doc_id", F.row_number().over(order).cast("long").alias("pos"), "token", "added")


def splice(text: Column, emphasis: Column, runs: Column) -> Column:
    """text, emphasis (places of words from 0) and placed (a flag a run) after ``runs`` (array of words and after) are put in.

    A run goes behind the first place of its ``after``, in front of everything if that is empty, and nowhere if the text
    hasn't got it; emphasis behind it moves by its words.
    """
    count = lambda t: F.regexp_count(t, F.lit(r"\S+"))

    def step(s: Column, r: Column) -> Column:
        found = F.position(r["after"], s["text"])
        place = F.when(r["after"] == "", 0).when(found > 0, found + F.length(r["after"]) - 1)
        left, right = F.substring(s["text"], F.lit(1), place), F.substring(s["text"], place + 1, F.length(s["text"]))
        joined = F.when(place == 0, F.rtrim(F.concat(r["words"], F.lit(" "), F.ltrim(s["text"])))).otherwise(F.concat(left, F.lit(" "), r["words"], right))
        at, by = count(left), count(r["words"])
        moved = F.transform(s["emphasis"], lambda e: F.when(e >= at, e + by).otherwise(e))
        here = place.isNotNull()
        return F.struct(F.when(here, joined).otherwise(s["text"]).alias("text"), F.when(here, moved).otherwise(s["emphasis"]).alias("emphasis"), F.concat(s["placed"], F.array(here)).alias("placed"))

    return F.aggregate(runs, F.struct(text.alias("text"), emphasis.cast("array<int>").alias("emphasis"), F.array().cast("array<boolean>").alias("placed")), step)


def bare(t: Column) -> Column:
    """The words of a text without case and marks, a blank between."""
    return F.array_join(F.filter(F.transform(F.split(t, r"\s+"), plain), lambda w: w != ""), " ")


def bare_spot_id(page: Column, words: Column, before: Column, after: Column) -> Column:
    """``spot_id`` of texts that are ``bare``."""
    return F.concat(F.lit("p"), page.cast("string"), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", page.cast("string"), words, before, after), 256), 1, 16))


def spot_id(page: Column, words: Column, before: Column, after: Column) -> Column:
    """The name of a spot on a page, by what stands there and beside it: other spots of the list don't change it."""
    return bare_spot_id(page, *map(bare, (words, before, after)))
