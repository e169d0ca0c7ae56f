import itertools
import random

import numpy as np
import pytest

from leafmill.functions import images
from leafmill.operators import hyphens, lines, pictures


def picture(h=7, w=9, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4), np.uint8)


def test_sizes_agree_with_pixels():
    rng = random.Random(3)
    for _ in range(60):
        ops = [rng.choice([("crop", {"x": rng.randint(-2, 12), "y": rng.randint(-2, 9), "width": rng.randint(0, 12), "height": rng.randint(0, 9)}), ("rotate", {"degrees": rng.choice([0, 90, 180, 270, 33])}), ("grayscale", {}), ("none", {})]) for _ in range(4)]
        img = picture()
        out = images.apply_ops(img, ops)
        assert (out.shape[1], out.shape[0]) == images.size_after(9, 7, ops)


def test_kernels():
    img = picture()
    before = img.copy()
    assert np.array_equal(images.apply_ops(img, [("rotate", {"degrees": 90})] * 4), img)
    assert np.array_equal(images.levels(img, {}), img) and np.array_equal(images.curves(img, {"points": "bad"}), img)
    assert np.array_equal(images.curves(img, {"points": "[[0,0],[255,255]]"}), img) and np.array_equal(images.contrast(img, {"amount": 0}), img)
    assert images.brightness(img, {"amount": 100})[..., :3].min() == 255
    assert set(np.unique(images.threshold(img, {})[..., :3])) <= {0, 255}
    grey = images.grayscale(img)
    assert np.array_equal(grey[..., 0], np.floor(images.luma(img) + 0.5)) and np.array_equal(grey[..., 3], img[..., 3])
    spot = np.full((5, 5, 4), 250, np.uint8)
    spot[2, 2, :3] = 0
    assert images.despeckle(spot)[2, 2, 0] == 250
    ring = np.full((6, 6, 4), 255, np.uint8)
    ring[1:5, 1:5, :3] = 0
    ring[2:4, 2:4, :3] = 255
    clear = images.remove_background(ring, {"tolerance": 10})[..., 3] == 0
    assert clear[0].all() and not clear[1:5, 1:5].any()
    assert np.array_equal(before, img)
    share, box = pictures.ink(np.where(np.arange(100).reshape(10, 10, 1) == 37, 0, 255).astype(np.uint8).repeat(4, 2))
    assert share == 0.01 and box == (7, 3, 8, 4)


def test_free_rectangles_are_all_the_maximal_ones():
    rng = np.random.default_rng(1)
    for _ in range(20):
        taken = rng.random((6, 7)) < 0.3
        free = [(t, l, b, r) for t, b in itertools.combinations(range(7), 2) for l, r in itertools.combinations(range(8), 2) if not taken[t:b, l:r].any()]
        want = sorted(x for x in free if not any(y != x and y[0] <= x[0] and y[1] <= x[1] and y[2] >= x[2] and y[3] >= x[3] for y in free))
        got = pictures.empty_rectangles(taken)
        assert set(want) <= set(got) and set(got) <= set(free)


def test_lines_are_broken_at_least_cost():
    rng = random.Random(2)
    for _ in range(25):
        words = ["x" * rng.randint(1, 9) for _ in range(rng.randint(1, 9))]
        found = lines.break_paragraph(words, 20, 2.0, 0.5)
        assert [k for i, j, _ in found for k in range(i, j)] == list(range(len(words)))
        assert all(sum(map(len, words[i:j])) + (j - i - 1) * (1 - 1 / 3) <= 20 + 1e-9 for i, j, _ in found)
    assert lines.break_paragraph([], 20) == []
    assert [(i, j) for i, j, _ in lines.break_paragraph(["a" * 50, "b"], 20, 2.0)] == [(0, 1), (1, 2)]


@pytest.mark.parametrize("rows", [[], [(1, 0, None)], [(1, 0, "a few words here")]])
def test_break_blocks(spark, rows):
    got = lines.break_blocks(spark.createDataFrame(rows, "doc_id long, bi long, text string")).collect()
    assert [r.text for r in got] == [t for _, _, t in rows if t]


def test_words_are_broken_where_that_is_best():
    """Against all ways to break short paragraphs of words in parts."""
    import itertools

    rng = random.Random(6)
    for _ in range(120):
        words = [["x" * rng.randrange(1, 5) for _ in range(rng.choice([1, 1, 2, 3]))] for _ in range(rng.randrange(1, 6))]
        pieces = [(len(p), k == len(w) - 1) for w in words for k, p in enumerate(w)]
        n, measure, best = len(pieces), rng.choice([6, 8, 11]), None
        for cuts in itertools.product([0, 1], repeat=n - 1):
            ends = [k + 1 for k, c in enumerate(cuts) if c] + [n]
            cost, at = 0.0, 0
            for j in ends:
                wide = sum(w for w, _ in pieces[at:j]) + (not pieces[j - 1][1])
                gaps = sum(last for _, last in pieces[at : j - 1])
                slack = measure - wide - gaps
                if slack < 0 and (wide + gaps - gaps / 3 > measure) and j - at > 1:
                    cost = None
                    break
                ratio = (0.0 if j == n else slack / (gaps * 0.5) if gaps else 0.0 if slack == 0 else float("inf")) if slack >= 0 else slack / (gaps / 3) if gaps else -1.0
                if j < n and ratio > 4:
                    cost = None
                    break
                cost += (1 + 100 * min(abs(ratio), 1e3) ** 3 + (0 if pieces[j - 1][1] else 50)) ** 2
                at = j
            if cost is not None and (best is None or cost < best):
                best = cost
        if best is None:
            continue
        found, total = lines.break_words(words, float(measure), 2.0), 0.0
        for _, j, ratio in found:
            total += (1 + 100 * min(abs(ratio), 1e3) ** 3 + (0 if pieces[j - 1][1] else 50)) ** 2
        assert total == pytest.approx(best)


def test_hyphenated_lines_hold_the_paragraphs_words(spark):
    patterns = spark.createDataFrame([("a1b",), ("e1d",), ("o1n",)], "pattern string")
    text = "abandoned towers and abandoned bonded dens on fabled ponds, tabbed " * 6
    rows = spark.createDataFrame([(1, 0, text), (1, 1, ""), (1, 2, None)], "doc_id long, bi long, text string")
    got = lines.break_hyphenated(rows, patterns, 70.0, 10.0).orderBy("bi", "line").collect()
    assert {r.bi for r in got} == {0} and any(r.text.endswith("-") for r in got)
    assert "".join(r.text[:-1] if r.text.endswith("-") else r.text + " " for r in got).split() == text.split()


def test_cells_of_boxes_are_never_sent_whole_to_all(spark):
    boxes = spark.createDataFrame([(0, k, 0.0, 0.0, 900.0, 900.0) for k in range(3)], "page long, id long, x0 double, y0 double, x1 double, y1 double")
    plan = pictures._named(boxes, ["page"], 50)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_regions_of_a_page_are_joined_without_cells(spark, monkeypatch):
    """Large regions lie on hundreds of cells each, which at 1 GB of documents didn't fit on the disk."""
    monkeypatch.setattr(pictures, "_named", None)
    rows = [(d, 0, n, *box) for d in range(3) for n, box in enumerate([(0.0, 0.0, 900.0, 300.0), (0.0, 350.0, 900.0, 700.0), (0.0, 800.0, 500.0, 1000.0)])]
    found = pictures.illustrations(spark.createDataFrame(rows, pictures.REGIONS), 55)
    assert sorted(tuple(r)[2:] for r in found.where("doc_id = 1").collect()) == [(0, 0.0, 0.0, 900.0, 700.0), (1, 0.0, 800.0, 500.0, 1000.0)]
    assert found.count() == 6 and pictures.illustrations(spark.createDataFrame([], pictures.REGIONS), 55).count() == 0


def test_boxes_join_in_arrays_as_on_cells(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(p, x, y, x + rng.randrange(9), y + rng.randrange(9)) for p in range(1, 30) for x, y in ((rng.randrange(60) / 2, rng.randrange(60) / 2) for _ in range(rng.randrange(1, 25)))]
    boxes = spark.createDataFrame([(p, *map(float, b)) for p, *b in rows], "page long, x0 double, y0 double, x1 double, y1 double")
    all_ = lambda: sorted(map(tuple, pictures.merge_nearby(boxes, ["page"], 2.0).collect()))
    found = all_()
    monkeypatch.setattr(pictures, "TOGETHER", 10)
    assert all_() == found and len(found) < len(rows)
    before = np.array([[0.0, 0.0, 1.0, 1.0], [5.0, 0.0, 6.0, 1.0], [2.0, 0.0, 4.0, 1.0]])
    assert pictures.joined(before, 1.0).tolist() == [[0, 0, 6, 1]] and before[0, 2] == 1


def test_blank_regions_send_no_words_to_python(spark):
    words = spark.createDataFrame([(0, 0, 0.0, 0.0, 320.0, 10.0), (0, 0, 0.0, 300.0, 320.0, 320.0), (0, 0, -5.0, 100.0, 20.0, 101.0)], "doc_id long, page_index long, x0 double, y0 double, x1 double, y1 double")
    found = pictures.blank_regions(words, 320, 320)
    assert "MapInPandas" in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[2:] for r in found.orderBy("n").collect()] == [(0, 20.0, 10.0, 320.0, 300.0), (1, 0.0, 110.0, 320.0, 300.0), (2, 0.0, 10.0, 320.0, 100.0)]


def test_many_paragraphs_are_set_as_each_alone(spark, monkeypatch):
    monkeypatch.setattr(lines, "CELLS", 200)
    rng = random.Random(6)
    bricks = ["ab", "onon", "x", "thanded", "B", "tion", "é", "ati", "zz9", "und"]
    texts = [" ".join("".join(rng.choices(bricks, k=rng.choice([1, 1, 2, 5, 12]))) for _ in range(rng.randrange(40))) for _ in range(80)]
    table = spark.createDataFrame([("a1b",), ("n1d",), ("n2de",), ("o1n",), ("1tion",), ("ti4on",), (".a2",), ("2d.",)], "pattern string")
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, bi long, text string")
    words = sorted({w for t in texts for w in t.split() if w.isalpha()})
    broken = hyphens.breaks(spark.createDataFrame([(w,) for w in words], "word string"), table)
    parts = {r.word: r.parts for r in hyphens.parts(broken).collect()}
    known = hyphens.tree(hyphens.collected(table))
    assert {r.word: r.at for r in broken.collect()} == {w: hyphens.places(w, known) for w in words}
    got = [tuple(r) for r in lines.break_hyphenated(rows, table, 60.0, 10.0).orderBy("bi", "line").collect()]
    assert got == [(1, k, *line) for k, t in enumerate(texts) for line in lines._set([parts.get(w, [w]) for w in t.split()], 60.0, 10.0)]
    plan = lines.break_hyphenated(rows, table)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
