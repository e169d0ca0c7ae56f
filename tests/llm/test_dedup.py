import hashlib
import random

import pytest

from leafmill.llm import line_dedup, minhash, suffix_dedup
from leafmill.llm.simhash import Words

from .helpers import DOCS, cases, wide


def bytes_left(rows, least):
    """Brute force: every string of ``least`` bytes against all that start before it."""
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - least + 1):
            s = data[p : p + least]
            if s in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(s)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[key] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", 700)  # so that long texts go in parts
    rng = random.Random(5)
    passages = ["".join(rng.choice("abcde ") for _ in range(rng.randint(60, 400))) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("fghij ") for _ in range(rng.randint(0, 300))) for _ in range(rng.randint(0, 6))]
        text = "".join(p[rng.randint(0, 40) :] for p in parts)
        rows.append((i, text))
    rows += [(100, "z" * 900), (101, "ab" * 500), (102, "é" * 150), (103, None), (104, ""), (105, rows[3][1])]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    want = bytes_left(rows, 100)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert len(got) == len(rows)


@pytest.mark.parametrize("least", [8, 64, 95, 128, 190])
def test_suffix_dedup_at_other_lengths(spark, least):
    rng = random.Random(least)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    passages = ["".join(rng.choice(words) for _ in range(rng.randint(5, 80))) for _ in range(8)]
    rows = []
    for i in range(70):
        text = "".join(rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.5 else "".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6)))
        rows.append((i, text))
    changed = list(rows[5][1] * 3 + passages[0] * 2)
    for at in range(40, len(changed), 97):
        changed[at] = "#"
    rows += [(200, rows[5][1] * 3 + passages[0] * 2), (201, "".join(changed)), (202, "y" * 700), (203, None)]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS).repartition(3), least).collect()}
    want = bytes_left(rows, least)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and len(got) == len(rows)


def test_a_hot_string_is_found_over_many_tasks(spark):
    """One passage in every document, between different surroundings, so that its windows fill several tasks."""
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    noise = lambda: "".join(rng.choice("ijklmnop ") for _ in range(rng.randint(20, 60)))
    rows = [(i, noise() + passage + noise()) for i in range(200)]
    got = {r[0]: tuple(r)[1:] for r in suffix_dedup.dedup(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert got == bytes_left(rows, 100)


def test_suffix_dedup_of_every_case(spark):
    rows = suffix_dedup.dedup(wide(spark, cases()), with_text=True).collect()
    assert len(rows) == len(cases())
    of = {r.doc_id: r for r in rows}
    assert of[2].n_bytes == of[3].n_bytes == 0 and of[6].n_removed >= 0
    assert bytes(of[7].kept).endswith(b" tail") and len(of[7].kept) < 200
    assert of[8].n_removed == 0
    assert suffix_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def lines_left(rows, run):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - run + 1):
            name = tuple(lines[p : p + run])
            if name in seen:
                gone.update(range(p, p + run))
            seen.add(name)
        out[key] = (len(lines), len(gone), sum(1 for g in gone if g - 1 not in gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("gram,window", [(2, 2), (1, 3), (3, 2), (1, 1)])
def test_line_dedup_against_brute_force(spark, gram, window):
    rng = random.Random(gram * 7 + window)
    rows = [(i, "\n".join(rng.choice("abcdefgh") * rng.randint(0, 2) for _ in range(rng.randint(1, 30)))) for i in range(80)]
    got = {r[0]: tuple(r)[1:] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), gram, window).collect()}
    assert got == lines_left(rows, gram + window - 1)


def runs_left(rows, run, words):
    seen, out = set(), {}
    for key, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for p in range(len(lines)):
            for n in range(1, run + 1):
                name = tuple(lines[p : p + n])
                if len(name) == n and (n == run or sum(len(x.split()) for x in name) >= words):
                    if name in seen:
                        gone.update(range(p, p + n))
                    seen.add(name)
        out[key] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup_of_many_words_against_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 5, 6, 9, 10, 11, 14)]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.4 else f"line {i} {k}" for k in range(rng.randint(1, 12)))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), words=10).collect()}
    assert got == runs_left(rows, 3, 10)
    assert got != {k: v[3] for k, v in lines_left(rows, 3).items()}


def test_a_repeated_long_line_goes_in_the_pipeline(spark):
    passage, half = " ".join(f"p{k}" for k in range(50)), " ".join(f"h{k}" for k in range(25))
    rows = [(1, passage), (2, passage), (3, "a\n" + passage + "\nb"), (4, passage + " more"), (5, half + "\n" + half.upper()), (6, half + "\n" + half.upper() + "\nc"), (7, half)]
    got = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: passage, 2: "", 3: "a\nb", 4: passage + " more", 5: rows[4][1], 6: "c", 7: half}


def test_line_dedup_of_every_case(spark):
    block = "one\ntwo\nthree\nfour"
    docs = wide(spark, [*cases(), (20, block), (21, "zero\n" + block), (22, block)])
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    of = {r.doc_id: r for r in out.collect()}
    assert (of[20].text, of[21].text, of[22].text) == (block, "zero", "")
    assert (of[21].n_chars, of[22].n_chars, of[2].text, of[21].kept, of[21]["class"]) == (4, 0, None, "kept", "c")
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for i in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy)))
    docs = spark.createDataFrame(rows, DOCS)
    idf = minhash.document_frequencies(docs)
    words = Words()
    sets = [minhash.shingles(words.of(t.lower()), idf) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if minhash.jaccard(sets[a], sets[b]) >= 0.8:
                p, q = sorted((find(a), find(b)))
                part[q] = p
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_duplicates(docs, block=8).collect()}
    assert got == {i: (find(i), find(i) == i) for i, _ in rows}


@pytest.mark.parametrize("most", [1 << 17, 9000, 1])
def test_weights_are_those_of_exact_document_frequencies(spark, monkeypatch, most):
    """Frequent words, rare ones of several documents and ones of a single document; those in too few weigh alike."""
    import numpy as np

    monkeypatch.setattr(minhash, "COMMON", most)
    monkeypatch.setattr(minhash, "bands", lambda names, weights, n_bands, rows: (weights.astype("float64").view("uint64"), np.zeros(2, "uint16")))
    rng = random.Random(6)
    rows = [(i, " ".join([f"f{rng.randrange(10)}" for _ in range(6)] + [f"r{rng.randrange(40)}" for _ in range(5)] + [f"o{i}x{k}" for k in range(2000)])) for i in range(60)]
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, "F1 r2"), (102, None), (103, "")]
    df = {}
    for _, text in rows:
        for w in set((text or "").lower().split()):
            df[w] = df.get(w, 0) + 1
    docs, least = spark.createDataFrame(rows, DOCS), sum(df.values()) // most + 1
    got = {r.k: r.bands for r in minhash._signatures(docs, minhash.document_frequencies(docs), 1, 1).collect()}
    for key, text in rows:
        own = (text or "").lower().split()
        if not own:
            assert got[key] is None
            continue
        idf = np.log1p(len(rows) / (1 + np.array([max(df[w], least) for w in own])))
        size = min(5, len(own))
        want = {}
        for p in range(len(own) - size + 1):
            name = tuple(own[p : p + size])
            want[name] = want.get(name, 0) + idf[p : p + size].sum() / size
        assert np.allclose(sorted(np.array(got[key]).view("float64")), sorted(want.values()), rtol=1e-4)


def test_unlinked_members_of_a_bucket_are_compared_in_blocks(spark, monkeypatch):
    """All in one bucket: two families whose members link only among themselves, and loners."""
    zeros = __import__("numpy").zeros
    monkeypatch.setattr(minhash, "bands", lambda names, weights, n_bands, rows: (zeros(n_bands, "uint64"), zeros(2, "uint16")))
    make = lambda tag, edit: " ".join([f"{tag}{k}" for k in range(60)] + [edit])
    rows = [(i, make("a", f"x{i}")) for i in range(9)] + [(i, make("b", f"x{i}")) for i in range(20, 31)] + [(i, make(f"c{i}", "")) for i in range(40, 46)]
    docs = spark.createDataFrame(rows, DOCS)
    signed = minhash._signatures(docs, minhash.document_frequencies(docs), 2, 3)
    assert signed.count() == len(rows)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, n_bands=2, block=4).collect()}
    assert got == {i: 0 if i < 9 else 20 if i < 40 else i for i, _ in rows}


def test_near_duplicates_of_every_case(spark):
    docs = wide(spark, cases())
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == len(cases())
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert of[3][0].class_id == of[4][0].class_id == of[9][0].class_id == 2 and of[7][0].class_id == 6
    assert of[None][0].kept and of[None][0].class_id is None and len(of[8]) == 2
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 5, 6, 8]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_weighted_jaccard():
    import numpy as np

    a = (np.array([1, 2, 5], np.uint64), np.array([1, 2, 1], np.float32))
    b = (np.array([2, 5, 9], np.uint64), np.array([1, 1, 3], np.float32))
    assert minhash.jaccard(a, b) == pytest.approx(2 / 7)
