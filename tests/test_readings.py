"""Readings compared: the alignment against an exact search, whole readings with repeated words, and words put back."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill import registry
from leafmill.operators import readings, verify
from leafmill.plans import views

TOKENS = "doc_id long, pos long, token string"


def search(own, other):
    """(left-out words, gaps) of the best alignment, by a plain table."""
    far = (10**9, 0)
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    kept = [[far] * (len(other) + 1) for _ in range(len(own) + 1)]
    gone = [[far] * (len(other) + 1) for _ in range(len(own) + 1)]
    for i in range(len(own) + 1):
        for j in range(len(other) + 1):
            if not i and not j:
                kept[0][0] = (0, 0)
                continue
            if i:
                gone[i][j] = min(add(gone[i - 1][j], (1, 0)), add(kept[i - 1][j], (1, 1)))
            if j:
                kept[i][j] = min(kept[i][j - 1], gone[i][j - 1])
            if i and j and own[i - 1] == other[j - 1]:
                kept[i][j] = min(kept[i][j], kept[i - 1][j - 1], gone[i - 1][j - 1])
    return min(kept[-1][-1], gone[-1][-1])


def test_the_alignment_is_the_best():
    rng = random.Random(5)
    for _ in range(600):
        own = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(14))]
        other = [rng.choice("abc") for _ in range(rng.randrange(14))] if rng.random() < 0.5 else [w for w in own if rng.random() < 0.7]
        runs = readings.settled(own, other, readings.left_out(own, other))
        assert sum(n for _, n, _ in runs) == search(own, other)[0]
        assert all(s + n <= t for (s, n, _), (t, _, _) in zip(runs, runs[1:]))
        assert len(runs) <= search(own, other)[1]
        left, used = [w for k, w in enumerate(own) if not any(s <= k < s + n for s, n, _ in runs)], 0
        for w in other:  # what stays is in the other reading, in order
            used += used < len(left) and left[used] == w
        assert used == len(left)
        assert all(0 <= at <= len(other) for _, _, at in runs)


def test_long_stretches_of_one_word_and_of_two():
    own = ["nd"] * 20000
    assert readings.settled(own, own[:-7], readings.left_out(own, own[:-7])) == [(0, 7, 0)]
    blocks = ["E"] * 121 + ["nd"] * 121  # the end of one repetition and the start of the next
    assert readings.settled(blocks, blocks[:120] + blocks[128:], [(0, 1, 0), (130, 7, 129)]) == [(120, 8, 120)]
    two = ["a", "b"] * 1500 + ["c"] + ["b", "a", "a"] * 300
    other = two[:700] + two[732:2900] + two[2908:]
    runs = readings.settled(two, other, readings.left_out(two, other))
    assert sum(n for _, n, _ in runs) == 40 and len(runs) <= 2


def rows(texts):
    return [(d, k, w) for d, text in enumerate(texts) for k, w in enumerate(text, 1)]


def books(seed, n=60):
    rng = random.Random(seed)
    own, other, dropped = [], [], []
    for d in range(n):
        vocabulary = [f"W{k}{rng.choice(['', ',', '.'])}" for k in range(rng.choice([1, 2, 3, 20, 400]))]
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        gone = set()
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(text) + 1)
            gone |= set(range(at, min(len(text), at + rng.randrange(1, 12))))
        own.append(text)
        other.append([w for k, w in enumerate(text) if k not in gone])
        dropped.append(len(gone))
    return own, other, dropped


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_all_that_a_reading_lacks_is_found_and_put_back(spark, seed):
    own, other, dropped = books(seed)
    a, b = spark.createDataFrame(rows(own), TOKENS), spark.createDataFrame(rows(other), TOKENS)
    found = readings.described(readings.missing_runs(a, b), a, b)
    got = [0] * len(own)
    for r in found.collect():
        got[r.doc_id] += r.n
        assert own[r.doc_id][r.start - 1 : r.start - 1 + r.n] == r.words.split()
        text = " ".join(other[r.doc_id])
        assert r.before in text and r.after in text
    assert got == dropped
    back = {}
    for r in readings.put_back(b, found).orderBy("doc_id", "pos").collect():
        back.setdefault(r.doc_id, []).append(r.token)
    assert [back.get(d, []) for d in range(len(own))] == own


def test_a_changed_order_keeps_the_longest_chain(spark):
    assert readings.rising([5, 1, 2, 9, 3]) == [1, 2, 4] and readings.rising([]) == []
    words = [f"w{k}" for k in range(60)]
    a = spark.createDataFrame(rows([words]), TOKENS)
    b = spark.createDataFrame(rows([words[:10] + words[50:] + words[10:30] + words[33:50]]), TOKENS)
    runs = sorted((r.start, r.n) for r in readings.missing_runs(a, b).collect())
    assert runs == [(31, 3), (51, 10)]


PAGE = "The astral and the physical bodies are invariably connected by means of a sort of cord, or cable, along which vital currents pass. Should this cord be severed, death instantly results. The only difference between astral projection and death is that the cord is intact in the former case, and severed in the latter."


def scanned(spark, text, confidence=92):
    return spark.createDataFrame([(0, k, w, confidence if isinstance(confidence, int) else confidence(w), f"p16_w{k}") for k, w in enumerate(text.split(), 1)], TOKENS + ", confidence long, id string")


def found(spark, text, scan, **how):
    return readings.compare_readings(scan, spark.createDataFrame(rows([text.split()]), TOKENS), **how).orderBy("start").collect()


def test_runs_are_shown_by_length_and_confidence(spark):
    lost = "Should this cord be severed, death instantly results."
    short = PAGE.replace(f" {lost}", "")
    (run,) = found(spark, short, scanned(spark, PAGE))
    assert run.words == lost and run.strength == "strong" and run.before in short and run.after in short and run.confidence == 92
    assert run.ids[0] == f"p16_w{run.start}" and len(run.ids) == 8
    assert found(spark, PAGE, scanned(spark, PAGE)) == [] and found(spark, PAGE.replace(" invariably", ""), scanned(spark, PAGE)) == []
    (weak,) = found(spark, PAGE.replace(" invariably", ""), scanned(spark, PAGE), least=1)
    assert (weak.words, weak.strength) == ("invariably", "weak")
    assert found(spark, short, scanned(spark, PAGE, lambda w: 30 if w in lost else 92)) == []
    assert found(spark, PAGE, scanned(spark, " ".join(w for k, w in enumerate(PAGE.split()) if k % 7))) == []


def test_splices(spark):
    def spliced(text, emphasis, *runs):
        frame = spark.createDataFrame([(text, emphasis, [{"words": w, "after": a} for w, a in runs])], "t string, e array<int>, r array<struct<words:string,after:string>>")
        return frame.select(readings.splice(F.col("t"), F.col("e"), F.col("r")).alias("s")).first().s

    s = spliced("Of the alembick being set upon a fire", [2, 5], ("and of the fixed salt", "the alembick"))
    assert (s.text, s.emphasis, s.placed) == ("Of the alembick and of the fixed salt being set upon a fire", [2, 10], [True])
    s = spliced("the alembick being set", [1], ("Of these two", ""), ("lost", "nowhere"), ("now", "being"))
    assert (s.text, s.emphasis, s.placed) == ("Of these two the alembick being now set", [4], [True, False, True])
    assert spliced("", [], ("alone", "")).text == "alone" and spliced("x", [], ("y", "z"))[:2] == ("x", [])


def test_spot_names(spark):
    name = lambda *v: spark.createDataFrame([v], "p long, w string, b string, a string").select(readings.spot_id(F.col("p"), F.col("w"), F.col("b"), F.col("a")).alias("v")).first().v
    assert name(3, "the fixed salt,", "Of THE alembick", "") == name(3, "the Fixed salt", "of the alembick", "")
    assert len({name(9, "salt", "the alembick", ""), name(9, "salt", "a gentle fire", ""), name(10, "salt", "the alembick", "")}) == 3


def test_line_ends_are_healed(spark):
    def healed(*words):
        frame = spark.createDataFrame([(1, k, w, c, f"w{k}") for k, (w, c) in enumerate(words)], "page long, pos long, text string, confidence long, id string")
        return [(r.text, r.confidence, r.id) for r in verify.heal_line_breaks(frame, ["page"]).orderBy("pos").collect()]

    assert healed(("to", 94), ("pro-", 94), ("ceed", 60), ("on", 94)) == [("to", 94, "w0"), ("proceed", 60, "w1"), ("on", 94, "w3")]
    assert healed(("in-", 90), ("ter\xad", 80), ("est", 99)) == [("interest", 80, "w0")]
    assert healed(("a", 1), ("well-known", 2), ("fact-", 3)) == [("a", 1, "w0"), ("well-known", 2, "w1"), ("fact-", 3, "w2")]
    assert healed(("9-", 1), ("ten", 2), ("so-", 3), ("7", 4)) == [("9-", 1, "w0"), ("ten", 2, "w1"), ("so-", 3, "w2"), ("7", 4, "w3")]


def test_findings_of_pages(spark):
    read = " ".join(f"word{k}" for k in range(40))
    pages = [(1, "body", "", 0), (2, "body", read, 2), (3, "body", " ".join(read.split()[:20]), 1), (4, "title-page", "", 1), (5, "body", read + " " + read, 0), (6, "body", None, 0), (7, None, "", 0)]
    scans = [(p, k, w, 90) for p in (1, 2, 3, 4, 5, 7) for k, w in enumerate(read.split())]
    frames = spark.createDataFrame(pages, "page long, role string, text string, orphan_notes int"), spark.createDataFrame(scans, "page long, pos long, text string, confidence long")
    got = {}
    for r in verify.page_findings(*frames, ["page"]).orderBy("page", "place").collect():
        got.setdefault(r.page, []).append((r.code, r.severity, len(r.words)))
    assert got == {
        1: [("empty-page", "high", 0)], 2: [("orphan-footnote", "low", 0)], 3: [("text-dropped", "high", 0), ("confident-word-missing", "high", 12), ("orphan-footnote", "low", 0)],
        4: [("orphan-footnote", "low", 0)], 5: [("text-added", "medium", 0)], 7: [("empty-page", "high", 0)],
    }
    runs = {r.page: (r.n_findings, r.worst, r.codes) for r in verify.verify_run(*frames, ["page"]).collect()}
    assert 6 not in runs and runs[3] == (3, "high", "text-dropped,confident-word-missing,orphan-footnote") and len(runs) == 6
    assert verify.verify_run(*frames, ["page"], "left").where("page = 6").first().n_findings == 0


def test_words_that_meet_across_a_gap_cut_nothing(spark):
    """Words right before and behind the gap are, together, a run that the text has once elsewhere: it is no place to cut at."""
    line = "w0 w0 w1 ".split()
    own = line * 19 + "w0 w0 w0".split() + line * 24 + "w0 w1 w1 w0 w1".split() + line * 4 + "w0 w0 w1 w0 w1".split()
    rest = random.Random(192)
    v = [f"w{k}" for k in range(rest.choice([2, 3, 4, 6, 10]))]
    second = [rest.choice(v) for _ in range(rest.randrange(121, 200))]
    if rest.random() < 0.6:
        second = [w if rest.random() > 0.05 else rest.choice(v) for w in (second[: rest.randrange(3, 14)] * 60)[: len(second)]]
    texts = [own, second]
    other = [[w for k, w in enumerate(t) if not 120 <= k < 128] for t in texts]
    a, b = spark.createDataFrame(rows(texts), TOKENS), spark.createDataFrame(rows(other), TOKENS)
    found = readings.missing_runs(a, b).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r.doc_id: r.n for r in found} == {0: 8, 1: 8}


def test_places_that_are_forced():
    assert readings.forced("a b a c".split(), "a c".split()) == [(3, 1)] and readings.forced(["a"], ["b"]) is None
    assert readings.forced([], []) == [] and readings.forced("a b".split(), "b a".split()) is None


def test_lists_are_compared_as_rows_are(spark):
    own, other, _ = books(7)
    other[0], own[1] = [], []
    a, b = spark.createDataFrame(rows(own), TOKENS), spark.createDataFrame(rows(other), TOKENS)
    sides = spark.createDataFrame([(d, x or None, y or None) for d, (x, y) in enumerate(zip(own, other))], "doc_id long, own array<string>, other array<string>")
    got = sorted(map(tuple, readings.compare_lists(sides, least=1).collect()))
    assert got and got == sorted(map(tuple, readings.compare_readings(a, b, least=1).collect()))
    back = {r.doc_id: r.whole for r in readings.restored(readings.aligned(sides)).select("doc_id", "whole").collect()}
    assert back.pop(1) == other[1] and all(back[d] == own[d] for d in back)


def test_a_gap_between_equal_words_costs_no_table(monkeypatch):
    monkeypatch.setattr(readings, "_rows", None)
    own = ["a", "b"] * 400
    assert readings.left_out(own, own[:300] + own[400:]) == [(700, 100, 700)]
    assert readings.lacking(own + ["c"] + own, own + ["c"] + own[8:]) == [(801, 8, 801)]


def test_scans_are_cut_and_healed_in_arrays_as_in_rows(spark):
    rng = random.Random(11)
    words = ["abcdefg", "Straße", "x-", "soft\xad", "9-", "7", "naïvely-", "it", "äöüßéèà", "-", "a\xad", "end-\xad"]
    texts = [(d, " ".join(rng.choice(words) for _ in range(n))) for d, n in enumerate([0, 1, 2, 9, 10, 11, 249, 250, 251, 700, 40, 55])]
    texts += [(90, " ".join(["x-"] * 260)), (91, None), (92, " \n")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cut = views.cut_words(views.ocr_words(views.tokens(docs)))
    lists = views.cut_lists(views.word_lists(docs))
    said = lambda df: sorted(tuple(r) for r in df.select("doc_id", "page_index", "pos", "text", "confidence").collect())
    flat = lambda df: df.localCheckpoint().select("doc_id", F.inline("scan"))  # noqa: E731  else its filter would make the lists anew for each word
    assert said(flat(lists)) == said(cut)
    healed = said(verify.heal_line_breaks(cut, ["doc_id", "page_index"]))
    assert said(flat(verify.heal_lists(lists, "scan", "page_index"))) == healed and len(healed) < cut.count()


def test_totals_of_repeated_words_equal_sql(spark, tmp_path):
    """Where words repeat, gaps can be placed in several ways as cheaply; the totals go by places, as the SQL does."""
    runs = lambda *ws: " ".join(w for word, n in ws for w in [word] * n)
    texts = [
        runs(("Éenon", 121), ("de", 241), ("le", 124), ("leaiéaiç", 119), ("réelletion", 122), ("ierauxé", 120), ("la.", 121)),  # 1 + 15 or 8 + 8
        runs(("x", 401)), runs(("x", 121)), runs(("x", 122)), "", None, " \n", runs(*((f"w{k}", 1) for k in range(700))),
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["w06_dropped_totals"]).fetchall())
    assert sorted(map(tuple, registry.queries()["w06_dropped_totals"](spark, str(tmp_path)).collect())) == want
    assert [n for _, n in want] == [32, 8, 2, 24]
