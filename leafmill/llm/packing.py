"""Best-fit packing of token sequences.

Documents are tokenised, closed by an end id and, when longer than a sequence, cut into pieces. The pieces are
range-sorted by length; within a length their rank tells them apart. Open gaps are kept sorted by size as runs of
sequence numbers. Each round takes one length, longest first: a sweep finds the successor of that length among the
gaps, pieces that want the same gap size are matched to its sequences by rank, the gaps shrink, and the round repeats
until no gap is left, when new sequences open. Lengths are whole numbers up to the sequence's size, so the sorted
lists are held as at most that many runs: the sweep's state has a bound that the data can't raise. All rounds run
once on the driver, over the collected histogram of lengths; Spark only sorts the pieces, and each piece looks up its
own sequence in its own task.

Ids are those of the ``tokenizers`` library as it comes: a special token's name in a text is that token. Null text is
empty (one end id); a very long text is encoded in parts that are cut where the tokens can't change. Repeated rows are
packed each, ties of length go by the other columns; null ids are kept; an empty table gives none; other columns aren't
read.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding
from .common import Scratch, ranked, texts

#: A text longer than this many characters is encoded in parts, so that the library's own records of tokens stay small.
PART, TOGETHER = 1 << 16, 1 << 20
#: Letters, digits, marks and spaces whose classes no Unicode version has changed: both libraries split these alike.
_PLAIN = re.compile("[\t\n\r -~\xa1-\xac\xae-ſ‐-‧‰-›]*")
#: Between these two characters every byte-level splitting pattern cuts, and no special token holds a blank.
_SEAM = re.compile(r"(?<=[A-Za-z0-9.,;:!?])[ \n]")


@functools.lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _parts(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > PART and (cut := _SEAM.search(text, at + PART)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


@functools.lru_cache(2)
def _special(path: str) -> list[str]:
    return [t.content for t in _tokenizer(path).get_added_tokens_decoder().values()]


def token_ids(many: list[str], tokenizer: str, ranks: str | None = None, pattern: str | None = None) -> list[np.ndarray]:
    """``Tokenizer.encode(text, add_special_tokens=False).ids`` of each text, special tokens in a text included.

    Parts of plain characters without a special token's name go by the same vocabulary's rank file, if there is one,
    which gives the same ids at a third of the time.
    """
    parts = [_parts(t) for t in many]
    flat = [p for ps in parts for p in ps]
    ids: list[np.ndarray | None] = [None] * len(flat)
    if ranks:
        enc = encoding(ranks, pattern)[0]
        for k, part in enumerate(flat):
            if _PLAIN.fullmatch(part) and not any(name in part for name in _special(tokenizer)):
                ids[k] = np.array(enc.encode_ordinary(part), "<u4")
    rest, at = [k for k, x in enumerate(ids) if x is None], 0
    while at < len(rest):
        to, size = at, 0
        while to < len(rest) and (to == at or size + len(flat[rest[to]]) <= TOGETHER):
            size += len(flat[rest[to]])
            to += 1
        found = _tokenizer(tokenizer).encode_batch_fast([flat[k] for k in rest[at:to]], add_special_tokens=False)
        for k, e in zip(rest[at:to], found):
            ids[k] = np.array(e.ids, "<u4")
        at = to
    ends = np.cumsum([len(ps) for ps in parts]).tolist()
    return [np.concatenate(ids[a:b]) for a, b in zip([0, *ends], ends)]


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the first piece of a long document takes what the others leave."""

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for row, ids in enumerate(token_ids(texts(batch.column("text")), tokenizer, ranks, pattern)):
                ids = np.append(ids, np.array(end_id, "<u4")).astype("<u4")
                cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)] if len(ids) > size else [0, len(ids)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    keys.append(row)
                    out.append((piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keys, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, how many, first sequence, offset) for so many pieces of each length."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    moves, opened = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n and (at := bisect.bisect_left(order, length)) < len(order):
            gap = order[at]
            first, have = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            take = min(have, n - rank)
            moves.append((length, rank, take, first, size - gap))
            rank += take
            leave(gap, first + take, have - take)
            leave(gap - length, first, take)
        each = size // length
        for bins, held in (((n - rank) // each, each), (1, (n - rank) % each)):
            if bins and held:
                for k in range(held):
                    moves.append((length, rank, bins, opened, k * length))
                    rank += bins
                leave(size - held * length, opened, bins)
                opened += bins
    return moves


def pack(cut: DataFrame, size: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """``cut`` (pieces of at most ``size``) with sequence_id and offset."""
    scratch = scratch or Scratch(cut.sparkSession)
    names = cut.columns
    cut = scratch.keep(cut, "pieces")  # else the range sort's sample would tokenise all texts once more
    order = [F.col("length").desc(), *(F.col(c) for c in names if c != "length")]
    placed, starts = ranked(scratch, cut, order, "sorted")
    scratch.drop(cut)
    counts = {int(k): int(v) for k, v in placed.groupBy("length").count().collect()}  # at most ``size`` rows
    first, at = {}, 0
    for length in sorted(counts, reverse=True):
        first[length] = at
        at += counts[length]
    moves = np.array(sweep(counts, size), np.int64).reshape(-1, 5)
    begins = np.array([first[k] for k in moves[:, 0].tolist()], np.int64) + moves[:, 1]  # by global rank
    by = np.argsort(begins)
    moves, begins, starts = moves[by], begins[by], np.array(starts, np.int64)

    def run(batches):
        for batch in batches:
            rank = starts[batch.column("part").to_numpy(zero_copy_only=False)] + batch.column("idx").to_numpy(zero_copy_only=False)
            at = np.searchsorted(begins, rank, "right") - 1
            where = pa.array(moves[at, 3] + rank - begins[at], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), where, pa.array(moves[at, 4], pa.int64())], [*names, "sequence_id", "offset"]
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return placed.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, size: int = 2048) -> DataFrame:
    return pack(pieces(docs, tokenizer, ranks, pattern, size), size)
