import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leafmill.llm import bpe, packing

from .helpers import DOCS, cases, wide

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'st\n\t.,1é🙂　\x85\x1c"), max_size=120), st.integers(1, 9))
def test_tree_encoding_equals_whole_encoding(text, leaf):
    enc, sizes = bpe.encoding(MULTI, public_tokenizers.PATTERN)
    ids = bpe.tree_encode(text, enc, sizes, leaf)
    assert ids == enc.encode_ordinary(text)
    assert bpe.tree_decode(ids, enc, 3) == text.encode()


def test_round_trip_of_every_case(spark):
    enc, _ = bpe.encoding(MULTI, public_tokenizers.PATTERN)
    docs = wide(spark, cases())
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, MULTI, public_tokenizers.PATTERN, 64).collect())
    want = []
    for i, t in cases():
        ids = enc.encode_ordinary(t or "")
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    encoded = bpe.encode(docs, MULTI, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded, MULTI, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in decoded) == sorted((t or "").encode() for _, t in cases())
    assert bpe.round_trip(docs.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0


_MIXED = st.lists(st.one_of(st.text(max_size=30), st.sampled_from(["<|endoftext|>", " <|endoftext|> ", "a ", "9\n\n", ". It's", "   "])), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(_MIXED, max_size=4), st.sampled_from([None, RANKS]))
def test_ids_are_the_untouched_tokenizers(many, ranks):
    exact = Tokenizer.from_file(JSON)
    old, packing.PART = packing.PART, 7  # so that texts go in parts
    try:
        assert [x.tolist() for x in packing.token_ids(many, JSON, ranks, public_tokenizers.PATTERN)] == [exact.encode(t, add_special_tokens=False).ids for t in many]
    finally:
        packing.PART = old


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_sweep_places_all_and_is_best_fit(counts):
    moves = packing.sweep(counts, 40)
    used, seen = defaultdict(list), defaultdict(int)
    for length, rank, n, first, offset in moves:
        assert rank == seen[length]
        seen[length] += n
        for k in range(n):
            used[first + k].append((offset, length))
    assert dict(seen) == counts
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 40
    # one document at a time, longest first, into the smallest gap that takes it
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [g for g in gaps if g >= length]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - length)
            else:
                gaps.append(40 - length)
    assert len(used) == len(gaps)


def test_packed_documents(spark):
    every = [*cases(), (70, "a <|endoftext|> b<|endoftext|>"), (71, "x" * 300_000), (72, "no blank" * 9_000)]
    docs = wide(spark, every)
    rows = packing.pack_documents(docs, JSON, RANKS, public_tokenizers.PATTERN, 256).collect()
    exact = Tokenizer.from_file(JSON)
    want = []
    for i, t in every:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids), 256), len(ids)] if len(ids) > 256 else [0, len(ids)]
        want += [(i or 0, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        assert [o for o, _ in sorted(places)] == list(np.cumsum([0, *(n for _, n in sorted(places))])[:-1])
        assert sum(n for _, n in places) <= 256
    total = sum(r.length for r in rows)
    assert len(held) <= -(-total // 256) + 2


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_packing_little(spark, rows):
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), JSON).collect()
    assert [(r.doc_id, r.length, r.sequence_id, r.offset) for r in got] == [(1, 1, 0, 0)] * len(rows)
