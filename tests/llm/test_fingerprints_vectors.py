import hashlib
import random

import numpy as np

from leafmill.llm import simhash, vector_dedup

from .helpers import DOCS, cases, wide

VECTORS = "vec_id long, embedding array<float>, label int"


def test_edit_likeness_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice("alpha beta gamma delta épsilon zeta eta".split()) for _ in range(rng.randint(0, 60)))) for i in range(90)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = {r.doc_id: r for r in simhash.edit_likeness(docs).collect()}
    order = sorted(rows, reverse=True)
    words = simhash.Words()
    assert len(got) == len(rows)
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        own, other, after = (simhash.fingerprint(words.of(t)) for t in (text, edited, following))
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own.hex(), other.hex())
        assert (r.near_edited, r.near_next) == (simhash.likeness(own, other), simhash.likeness(own, after))


def test_edit_likeness_of_every_case(spark):
    rows = simhash.edit_likeness(wide(spark, cases())).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == sorted((i or 0, len(t or "")) for i, t in cases())
    twice = [r for r in rows if r.doc_id == 8]
    assert twice[0].fingerprint == twice[1].fingerprint and twice[0].near_next == 1 or twice[1].near_next == 1
    last = next(r for r in rows if r.doc_id is None)  # goes on with the greatest id, whose text is null
    assert last.edited_sha256 == hashlib.sha256(simhash.edited_text("an id that is null and a text that is not", "").encode()).hexdigest()
    for few in ([], [(7, "alone in the world")], [(None, "a"), (None, "b")]):
        assert simhash.edit_likeness(spark.createDataFrame(few, DOCS)).count() == len(few)


def test_radius_search_finds_all(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, (30, 16), np.uint8)
    rows = []
    for i in range(200):
        bits = np.unpackbits(base[i % 30])
        bits[rng.choice(128, rng.integers(0, 7), replace=False)] ^= 1
        rows.append((i, bytearray(np.packbits(bits).tobytes())))
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint binary")
    queries = prints.where("doc_id % 10 = 0")
    got = {(r.query_id, r.doc_id, r.distance) for r in simhash.within_radius(queries, prints, 3).collect()}
    far = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    want = {(i, j, far(a, b)) for i, a in rows if i % 10 == 0 for j, b in rows if i != j and far(a, b) <= 3}
    assert got == want and len(want) > 20
    counts = {bytes(r.fingerprint): r.n for r in simhash.counts_within(queries, prints, 3).collect()}
    assert counts == {bytes(a): sum(far(a, b) <= 3 for _, b in rows) for i, a in rows if i % 10 == 0}


def test_radius_search_finds_all_of_the_default_radius(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (10, 16), np.uint8)
    rows = []
    for i in range(300):
        bits = np.unpackbits(base[i % 10])
        bits[rng.choice(128, rng.integers(0, 18), replace=False)] ^= 1
        rows.append((i, bytearray(np.packbits(bits).tobytes())))
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint binary")
    far = lambda a, b: (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    got = {(r.query_id, r.doc_id, r.distance) for r in simhash.within_radius(prints.where("doc_id < 60"), prints).collect()}
    want = {(i, j, far(a, b)) for i, a in rows if i < 60 for j, b in rows if i != j and far(a, b) <= simhash.RADIUS}
    assert got == want and {d for _, _, d in want} >= {16, 17, 18, 19, 20}


def test_report_counts_edited_texts(spark):
    """Near copies: a few words of 300 changed, so that at least 0.8 of the five-word shingles stay."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 21):
        copy = list(base)
        for at in rng.sample(range(300), 1 + i % 4):
            copy[at] = f"new{i}x{at}"
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(300))) for i in range(30, 60)]
    got = {r.doc_id: r.n_within for r in simhash.fingerprint_report(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0] == 20


def test_report_has_every_row_once(spark):
    rows = [*cases(), *((100 * k, "the same text in each of these") for k in range(3)), (7, "the same text in each of these"), (100, None)]
    got = simhash.fingerprint_report(wide(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    assert {r.n_within for r in got if r.doc_id is not None and r.doc_id % 100 == 0 and r.n_chars} == {3}
    assert all(r.n_within is None for r in got if r.doc_id is None or r.doc_id % 100)
    assert simhash.fingerprint_report(spark.createDataFrame([], DOCS)).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        centre = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), (centre + rng.standard_normal(16) * rng.choice([0, 0.03, 0.09])).astype(np.float32).tolist(), int(k % 3)))
    rows += [(1000 + i, [1.0] * 16, 7) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [float("inf")] * 16, 1), (2004, [1.0] * 16, None), (2005, [], 1), (2006, [None] + [1.0] * 15, 1), (2007, [1.0] * 5, 7), (2008, [2.0] * 5, 7), (2009, [-0.0] + [1.0] * 15, 9), (2010, [0.0] + [1.0] * 15, 9)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, VECTORS), block=8).collect()}
    good = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links = {r[0]: [] for r in rows}
    for a in good:
        for b in good:
            if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links[a[0]].append(b[0])
                    links[b[0]].append(a[0])
    found = sum(n for n, _, _ in got.values())
    every = sum(map(len, links.values()))
    assert found >= 0.97 * every and all(got[k][0] <= len(v) for k, v in links.items())
    assert got[1000] == (39, 1000, True) and got[1039] == (39, 1000, False)
    assert all(got[k] == (0, k, True) for k in (2000, 2001, 2002, 2003, 2004, 2005, 2006))
    assert got[2008] == (1, 2007, False) and got[2010] == (1, 2009, False)
    assert all(kept == (k == c) for k, (_, c, kept) in got.items())


def test_vectors_of_repeated_ids(spark):
    """Unlike vectors of one vec_id, equal ones of several, and one vector under two labels, against all pairs of rows."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((12, 8))
    rows = []
    for i in range(90):
        k = int(rng.integers(0, 12))
        rows.append((int(rng.integers(0, 30)), (base[k] + rng.standard_normal(8) * rng.choice([0, 0, 0.01])).tolist(), int(rng.integers(0, 2))))
    rows += [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.0, 1.0, 0.01], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=4).collect())
    n = len(rows)
    near = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(n):
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                near[a][b] = bool(x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98)
    low = [r[0] for r in rows]
    for _ in range(n):
        low = [min([low[a], *(low[b] for b in range(n) if near[a][b])]) for a in range(n)]
    assert got == sorted((rows[a][0], sum(near[a]), low[a], rows[a][0] == low[a]) for a in range(n))


def test_vectors_odd_tables(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 2.0], 1, "x"), (1, [1.0, 2.0], 1, "y"), (1, [1.0, 2.0], 1, "y")], VECTORS + ", name string")
    assert sorted((r.vec_id or 0, r.n_links) for r in vector_dedup.near_vectors(rows).collect()) == [(0, 0), (1, 1), (1, 1)]
