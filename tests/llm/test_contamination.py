"""op12 against brute force: hidden passages, short items, hot windows and every odd case."""

import hashlib
import random
import re

import pytest

from leafmill.llm import decontam

from .helpers import DOCS, cases, wide

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(x) for x in windows}
    for doc, text in docs:
        w, hit, listed = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    listed |= {str(k) for k in windows[x] if k is not None}
        yield (doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(sorted(listed)).encode()).hexdigest(), bool(hit))


def found(spark, docs, items, **how):
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in decontam.digest(decontam.contamination(*frames, **how)).collect()), key=str)


@pytest.mark.parametrize("gram", [1, 3, 5, 10])
def test_equals_brute_force(spark, gram):
    rng = random.Random(gram)
    some = lambda n, of=40: " ".join(f"{rng.choice('aBé')}{rng.randrange(of)}" for _ in range(n))
    items = [(k, some(rng.choice([0, 1, 3, 7, 9, 10, 11, 30]))) for k in range(40)] + [(40, "Same same SAME " * 9), (41, None), (None, some(14)), (7, some(12))]
    docs = []
    for k in range(150):
        text = some(rng.randrange(120), 30)
        for _ in range(rng.randrange(3)):
            w = words(rng.choice(items)[1])
            at = rng.randrange(len(w) + 1)
            text += " - " + ", ".join(w[at : at + rng.randrange(2, 20)]).upper() + "; " + some(rng.randrange(5))
        docs.append((k, text))
    docs += [(150, "same! " * 400), (151, "same " * 9)]
    got = found(spark, docs, items, gram=gram)
    assert got == sorted(brute(docs, items), key=str) and any(r[5] for r in got) and not all(r[5] for r in got)


def test_every_shared_span_of_ten_words_is_found_whole(spark):
    rng = random.Random(1)
    item = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    docs = [(n, " ".join(["x"] * n + item[n : n + 5 + n] + ["y"] * 3)) for n in range(30)]
    r = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in r.collect()}
    assert got == {n: [(n + 1, n + 5 + n)] if 5 + n >= 10 else [] for n in range(30)}


def test_a_passage_of_a_third_of_documents_and_items(spark):
    rng = random.Random(2)
    hot = " ".join(f"hot{k}" for k in range(14))
    items = [(k, (hot if k % 3 == 0 else "") + " " + " ".join(f"i{rng.randrange(9**6)}" for _ in range(12))) for k in range(120)]
    docs = [(k, (hot + " " if k % 3 == 0 else "") + " ".join(f"d{rng.randrange(9**6)}" for _ in range(15))) for k in range(600)]
    assert found(spark, docs, items) == sorted(brute(docs, items), key=str)


def test_cases(spark):
    docs = cases()
    items = [(1, docs[5][1][:200]), (1, docs[5][1][:200]), (2, "zoë naïve"), (3, ""), (4, None), (5, "A ID THAT"), (6, "id, that")]
    assert found(spark, docs, items) == sorted(brute(docs, items), key=str)
    frame = decontam.digest(decontam.contamination(wide(spark, docs), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 k", "2 th", "3 wid", "4 len")))
    assert sorted((tuple(r) for r in frame.collect()), key=str) == sorted(brute(docs, items), key=str)
    assert found(spark, [], items) == [] and all(not r[5] for r in found(spark, docs, []))
