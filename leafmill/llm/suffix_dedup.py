"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A position's rank for its next h bytes is a 64-bit name, equal for equal strings (but for collisions). The names of 1, 2,
4, ... bytes are doubled where the text is; Spark sorts positions by the pair (rank at p, rank at p + offset), which is the
rank of the longer string, compares each row with the row before, and drops positions that have become unique. With
``least`` = 100 the strings grow from 32 to 64 to 100 bytes, at offsets 16, 32 and 36:

1. g bytes (the largest power of two up to ``least`` / 3), at sampled positions: of the strings of g bytes in a window of
   ``least`` bytes the one with the smallest name (leftmost of equals) stands for the window. Equal windows choose alike,
   so a window whose choice is unique is unique, and no repeat is lost. Unique choices are counted out before the sort.
   A row is the stretch of neighbouring windows that one choice stands for; all but the first of equal stretches repeat
   as a whole, and where one choice has several different stretches the first of each goes on.
2. 2 g bytes, from the choice on for windows that reach so far behind it, and up to its end for the others: each window
   is one or the other. Again all but the first of equal halves repeat as a whole, and of those whose 2 g bytes have
   several different halves the first goes on.
3. ``least`` bytes (an overlapping pair): each window of these halves. A window that equals the row before repeats.

Rows are sorted by their ranks and then by their place, so that the first of equal ones stands first and a frequent
string's rows may lie in many tasks; what a task can't see at its edges goes on to the next step, and after the last the
first and last row of each task are compared.

A document is (doc_id, text): rows that repeat both are the same document and get the same result; ids shared by
different texts are ordered by the text's hash; null ids come first. Null and empty texts have no bytes; texts under
``least`` bytes are never changed; very long texts are named in parts that overlap. An empty table gives none; other
columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, partitions, utf8

#: Work goes by so many bytes, so that the arrays stay in a core's cache; longer documents go in several parts.
PART = 1 << 18
_PLACE = np.uint64((1 << 20) - 1)
_BYTE_NAMES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA3B195354A39B70D)


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _LEFT
    out ^= b
    out *= _RIGHT
    out ^= out >> np.uint64(29)
    return out


def lengths(least: int) -> tuple[int, int]:
    """g, the bytes of a sampled string, and the longest power of two that fits into ``least``."""
    if least < 8:
        raise ValueError("least must be 8 at least")
    return 1 << (least // 3).bit_length() - 1, 1 << least.bit_length() - 1


def doubled(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Names of the 1, 2, 4, ... ``upto`` bytes from each position."""
    h, out = 1, {1: _BYTE_NAMES[data]}
    while h < upto:
        names = out[h]
        h *= 2
        out[h] = join_names(names[: -(h // 2)], names[h // 2 :]) if len(names) > h // 2 else names[:0]
    return out


def long_name(names: np.ndarray, h: int, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Names of ``size`` (h to 4 h) bytes from ``lo``: four strings of h bytes leave no gap."""
    out = size.astype(np.uint64)
    for k in range(4):
        out = join_names(out, names[lo + (size - h) * k // 3])
    return out


def stretches(data: np.ndarray, bounds: np.ndarray, least: int):
    """(rank and rank behind it of the choice's two halves, stretch's name, first window, windows, choice's place after the
    first window) over documents laid end to end."""
    g, h = lengths(least)
    names = doubled(data, h)
    grams = names[g]
    lows, w = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
    span = least - g + 1
    while 2 * w <= span:
        lows, w = np.minimum(lows[:-w], lows[w:]), 2 * w
    if w < span:
        lows = np.minimum(lows[: w - span], lows[span - w :])
    chosen = (lows & _PLACE).astype(np.int64)
    open_ = np.ones(len(chosen) + 1, bool)
    open_[-1] = False
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        open_[max(a, b - least + 1) : b] = False
    turn = chosen[1:] != chosen[:-1]
    valid = open_[:-1]
    begins = valid.copy()
    begins[1:] &= turn | ~valid[:-1]
    ends = valid.copy()
    ends[:-1] &= turn | ~valid[1:]
    lo, hi = np.flatnonzero(begins), np.flatnonzero(ends)
    c = chosen[lo]
    return names[g // 2][c], names[g // 2][c + g // 2], long_name(names[h], h, lo, hi - lo + least), lo, hi - lo + 1, c - lo


def parts(data: np.ndarray, bounds: np.ndarray, least: int):
    """(bytes, bounds, first row, first byte in that row) of about PART bytes; a long document's parts overlap."""
    row, n = 0, len(bounds) - 1
    while row < n:
        size = bounds[row + 1] - bounds[row]
        if size > PART:
            for at in range(0, int(size) - least + 1, PART):
                a, b = bounds[row] + at, min(bounds[row + 1], bounds[row] + at + PART + least - 1)
                yield data[a:b], np.array([0, b - a]), row, at
            row += 1
        else:
            to = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PART, "right")) - 1)
            yield data[bounds[row] : bounds[to]], bounds[row : to + 1] - bounds[row], row, 0
            row = to


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), F.hash("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"), "doc_id"
    )


def _sampled(docs: DataFrame, least: int, names_only: bool) -> DataFrame:
    """gram (the choice's name), left, right, name, k, th, lo, n, place of each stretch, or gram alone."""

    def run(batches):
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            for some, cuts, row, base in parts(data, bounds, least):
                if len(some) < least:
                    continue
                left, right, name, lo, n, place = stretches(some, cuts, least)
                cols = [pa.array(join_names(left, right).view(np.int64))]
                if not names_only:
                    of = np.searchsorted(cuts, lo, "right") - 1
                    at = pa.array(of + row)
                    cols += [pa.array(x.view(np.int64)) for x in (left, right, name)] + [batch.column("k").take(at), batch.column("th").take(at)]
                    cols += [pa.array((lo - cuts[of] + base).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["gram", "left", "right", "name", "k", "th", "lo", "n", "place"][: len(cols)])

    kinds = "gram long" if names_only else "gram long, left long, right long, name long, k long, th int, lo int, n int, place int"
    return _keyed(docs).select("k", "th", "text").mapInArrow(run, kinds)


def _int64(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])


def _reranked(rows: DataFrame) -> DataFrame:
    """``rows`` (left, right, name, k, th, lo and more) sorted by rank pair, name and place, with ``later``: true for all but
    the first of equal (left, right, name). First ones whose pair has no other name are left out, but at a task's edges."""
    n = partitions(rows.sparkSession)
    order = ["left", "right", "name", "k", "th", "lo"]

    def run(batches):
        before, held, held_joins = None, None, False  # the last row's ranks and name; the last first one, until the next is seen
        for batch in batches:
            if not len(batch):
                continue
            key = _int64(batch, "left", "right", "name")
            start = before is None
            known = np.concatenate([key[:, :1] if start else before, key], axis=1)
            other = (known[:2, 1:] != known[:2, :-1]).any(axis=0)
            new = other | (known[2, 1:] != known[2, :-1])
            if start:
                new[0], other[0] = True, False  # what the task before ends with isn't known here
            yield pa.RecordBatch.from_arrays([*batch.filter(pa.array(~new)).columns, pa.array(np.ones((~new).sum(), bool))], [*names, "later"])
            at = np.flatnonzero(new)
            if len(at):  # of equal pairs rows stand together: a first one has company if it or the next first one begins no pair
                joins = ~other[at]
                if held is not None and (held_joins or joins[0]):
                    yield held
                keep = joins | np.append(joins[1:], False)
                keep[-1] = False
                firsts = batch.take(pa.array(at))
                out = firsts.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.zeros(len(out), bool))], [*names, "later"])
                last, held_joins = firsts.slice(len(at) - 1), bool(joins[-1])
                held = pa.RecordBatch.from_arrays([*last.columns, pa.array([False])], [*names, "later"])
            before = key[:, -1:]
        if held is not None:
            yield held

    names = rows.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, f"{kinds}, later boolean")


def _halves(reps: DataFrame, least: int) -> DataFrame:
    """The two parts of stretches (k, th, text, spans) by how far their windows reach behind the choice, with their bytes."""
    g, h = lengths(least)
    middle = (least - g) // 2  # bytes of a window before its choice: up to here it reaches 2 g bytes from the choice's start

    def run(batches):
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            lists = batch.column("spans")
            cuts, flat = lists.offsets.to_numpy(), lists.values
            every = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "n", "place")}
            for row in range(len(batch)):
                text = data[bounds[row] : bounds[row + 1]]
                lo, n, place = (every[c][cuts[row] : cuts[row + 1]] for c in ("lo", "n", "place"))
                names = doubled(text, h)
                at, hi, out = lo + place, lo + n - 1, []
                for a, b, first in ((np.maximum(lo, at - middle), hi, at), (lo, np.minimum(hi, at - middle - 1), at - g)):
                    some = a <= b
                    a, b, p = a[some], b[some], first[some]
                    size = b - a + least
                    out.append((names[g][p], names[g][p + g], long_name(names[h], h, a, size), a, b - a + 1))
                left, right, name, a, n = (np.concatenate(x) for x in zip(*out))
                own, raw = pa.array(np.full(len(a), row)), text.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in (left, right, name)), *(batch.column(c).take(own) for c in ("k", "th"))]
                    + [pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32))]
                    + [pa.array([raw[x : x + m + least - 1] for x, m in zip(a.tolist(), n.tolist())], pa.binary())],
                    ["left", "right", "name", "k", "th", "lo", "n", "bytes"],
                )

    kinds = "left long, right long, name long, k long, th int, lo int, n int, bytes binary"
    return reps.select("k", "th", "text", "spans").mapInArrow(run, kinds)


def _windows(halves: DataFrame, least: int) -> DataFrame:
    """left, right, k, th, lo of each window of the halves (k, th, lo, n, bytes)."""
    _, h = lengths(least)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            raw, n = batch.column("bytes"), batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            names = doubled(np.frombuffer(b"".join(raw.to_pylist()), np.uint8), h)[h]
            starts = np.cumsum(n + least - 1) - (n + least - 1)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            p, own = starts[row] + step, pa.array(row)
            lo = batch.column("lo").to_numpy(zero_copy_only=False)[row] + step
            ranks = (pa.array(names[x].view(np.int64)) for x in (p, p + least - h))
            yield pa.RecordBatch.from_arrays([*ranks, *(batch.column(c).take(own) for c in ("k", "th")), pa.array(lo.astype(np.int32))], ["left", "right", "k", "th", "lo"])

    return halves.select("k", "th", "lo", "n", "bytes").mapInArrow(run, "left long, right long, k long, th int, lo int")


def _repeated(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """k, th, lo, n (1) of all but the first of equal windows."""
    order = ["left", "right", "k", "th", "lo"]
    kinds = "left long, right long, k long, th int, lo int, part int, edge int"

    def run(batches):
        before = last = None
        for batch in batches:
            if not len(batch):
                continue
            key = _int64(batch, "left", "right")
            known = np.concatenate([key[:, :1] if before is None else before, key], axis=1)
            same = (known[:, 1:] == known[:, :-1]).all(axis=0)
            if before is None:
                same[0] = False
                yield marked(batch.slice(0, 1), 1)
            yield marked(batch.filter(pa.array(same)), 0)
            before, last = key[:, -1:], batch.slice(len(batch) - 1)
        if last is not None:
            yield marked(last, 2)

    def marked(rows, edge):
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(len(rows), edge, np.int32))], [*order, "part", "edge"])

    ranked = windows.repartitionByRange(partitions(scratch.spark), *order).sortWithinPartitions(*order)
    found = scratch.keep(ranked.select(*order, F.spark_partition_id().alias("part")).mapInArrow(run, kinds), "repeated")
    # a task's first row repeats if the task before ended with the same string: two rows a task
    edges, more, end = sorted(found.where("edge > 0").collect(), key=lambda r: (r.part, r.edge)), [], None
    for r in edges:
        if r.edge == 2:
            end = (r.left, r.right)
        elif end == (r.left, r.right):
            more.append((r.k, r.th, r.lo, 1))
    out = found.where("edge = 0").select("k", "th", "lo", F.lit(1).alias("n"))
    return out.union(scratch.spark.createDataFrame(more, "k long, th int, lo int, n int"))


def repeated_spans(docs: DataFrame, least: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """k, th, spans (array of lo, n): first bytes of ``n`` windows from ``lo`` that also start earlier."""
    lengths(least)
    scratch = scratch or Scratch(docs.sparkSession)
    # written first: then both sides of the join are plain shuffles, and Spark can split the task of a frequent string
    twice = scratch.keep(_sampled(docs, least, True).groupBy("gram").count().where("count > 1").select("gram"), "twice")
    left = scratch.keep(_sampled(docs, least, False).join(twice.hint("shuffle_hash"), "gram").drop("gram"), "positions")
    scratch.drop(twice)
    ranked = scratch.keep(_reranked(left).drop("left", "right", "name"), "ranked")
    scratch.drop(left)
    spans = ["k", "th", "lo", "n"]

    reps = ranked.where("not later").groupBy("k", "th").agg(F.collect_list(F.struct("lo", "n", "place")).alias("spans"))
    with_text = _keyed(docs).drop("doc_id").join(reps.hint("shuffle_hash"), ["k", "th"])
    left = scratch.keep(_halves(with_text, least), "halves")
    second = scratch.keep(_reranked(left).select(*spans, "bytes", "later"), "ranked")
    scratch.drop(left)

    single = _repeated(_windows(second.where("not later"), least), scratch)
    every = [*(x.where("later").select(*spans) for x in (ranked, second)), single]
    return every[0].union(every[1]).union(every[2]).groupBy("k", "th").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def _removed(spans: list | None, size: int, least: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[list[int]] = []
    for s in sorted(spans or [], key=lambda s: s["lo"]):
        a, b = s["lo"], min(size, s["lo"] + s["n"] + least - 1)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, least: int = 100, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary) of every document."""
    spans = repeated_spans(docs, least)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, bounds = utf8(batch.column("text"))
            rows = []
            for row, found in enumerate(batch.column("spans").to_pylist()):
                text = data[bounds[row] : bounds[row + 1]]
                gone = _removed(found, len(text), least)
                edges = [0, *(x for ab in gone for x in ab), len(text)]
                kept = b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            take = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols[:take], kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: take + 1]
            )

    joined = _keyed(docs).join(spans.hint("shuffle_hash"), ["k", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    )
