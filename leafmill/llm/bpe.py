"""Byte-level BPE by a monoid tree reduction.

A text is halved down to leaves that are encoded alone; two neighbours are joined by encoding again a window around
their seam. The window grows on both sides until it ends at a place where a non-space character is followed by a
blank. No match of the splitting pattern can span such a place and none looks past it, so tokens outside the window
are proven equal to those of the whole text. Decoding concatenates the halves' bytes.

Null text is empty and gives no tokens; a very long text without blanks is one window, encoded whole; rows are
independent, so repeated rows and ids give repeated results; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import texts

LEAF_CHARS = 16384


@functools.lru_cache(4)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoder and each token's length in bytes; a vocabulary is a fixed file that every worker has."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def _stable(text: str, at: int) -> bool:
    return text[at] in " \n\t" and not text[at - 1].isspace()


def _window(text: str, lo: int, seam: int, hi: int) -> tuple[int, int]:
    left, right = seam, seam
    while left > lo and not (left < hi and _stable(text, left)):
        left -= 1
    while right < hi and not (right > seam and _stable(text, right)):
        right += 1
    return left, right


def _covering(ids: list[int], sizes: np.ndarray, size: int, back: bool) -> int:
    """How many ids from one end cover ``size`` bytes."""
    n = covered = 0
    while covered < size:
        covered += sizes[ids[-1 - n if back else n]]
        n += 1
    return n


def tree_encode(text: str, enc: tiktoken.Encoding, sizes: np.ndarray, leaf: int = LEAF_CHARS) -> list[int]:
    def node(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return enc.encode_ordinary(text[lo:hi])
        seam = (lo + hi) // 2
        left, right = node(lo, seam), node(seam, hi)
        a, b = _window(text, lo, seam, hi)
        keep = len(left) - _covering(left, sizes, len(text[a:seam].encode()), back=True)
        skip = _covering(right, sizes, len(text[seam:b].encode()), back=False)
        return left[:keep] + enc.encode_ordinary(text[a:b]) + right[skip:]

    return node(0, len(text))


def tree_decode(ids: list[int], enc: tiktoken.Encoding, leaf: int = LEAF_CHARS) -> bytes:
    if len(ids) <= leaf:
        return enc.decode_bytes(ids)
    half = len(ids) // 2
    return tree_decode(ids[:half], enc, leaf) + tree_decode(ids[half:], enc, leaf)


def encode(docs: DataFrame, vocabulary: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""

    def run(batches):
        enc, sizes = encoding(vocabulary, pattern)
        for batch in batches:
            ids = [tree_encode(t, enc, sizes, leaf) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_type(docs)}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, bytes (binary) of every row of ids."""

    def run(batches):
        enc, _ = encoding(vocabulary, pattern)
        for batch in batches:
            out = [tree_decode(x or [], enc, leaf) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {_type(encoded)}, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, leaf: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes and decodes a text at a time, so no token array is kept."""

    def run(batches):
        enc, sizes = encoding(vocabulary, pattern)
        for batch in batches:
            counts, hashes, back = [], [], []
            for text in texts(batch.column("text")):
                ids = tree_encode(text, enc, sizes, leaf)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(tree_decode(ids, enc, leaf)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {_type(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()
