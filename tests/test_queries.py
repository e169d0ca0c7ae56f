"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from leafmill import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (int, bool)):
        return float(v)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, DATA)
    cols = sorted(found.columns)
    got = Counter(plain(r) for r in found.select(*[f"`{c}`" for c in cols]).collect())
    asked = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in asked.description]
    want = Counter(plain(tuple(r[names.index(c)] for c in cols)) for r in asked.fetchall())
    assert sorted(names) == cols
    assert got == want


def rows(spark, name):
    return registry.queries()[name](spark, DATA).collect()


def words(text):
    return text.split()


def test_archives_give_the_pages_blocks(spark):
    direct = Counter((r.page_id // 4, r.page_id % 4, r.n, r.kind, r.level, r.text) for r in rows(spark, "s14_page_blocks"))
    bound = Counter((int(r.path[4:-5]), r.page_index, r.n, r.kind, r.level, r.text) for r in rows(spark, "s09_epub_pages"))
    assert direct == bound and len(direct) > 100


def test_walked_pages_hold_their_pages_letters_only(spark):
    """The blocks of a page have no letter more than its text without tags, and most of them."""
    found, whole = {}, {r.page_id: Counter(filter(str.isalpha, r.text)) for r in rows(spark, "s18_text_of")}
    for r in rows(spark, "s14_page_blocks"):
        found.setdefault(r.page_id, Counter()).update(filter(str.isalpha, r.text))
    assert found and sum(c <= whole[k] for k, c in found.items()) >= 0.95 * len(found)
    assert sum(c.total() for c in found.values()) >= 0.5 * sum(c.total() for c in whole.values())


def test_broken_lines_are_the_paragraphs_words(spark, duck):
    from leafmill.plans.views import SQL

    found = {}
    for r in sorted(rows(spark, "w20_break_lines"), key=lambda r: (r.doc_id, r.bi, r.line)):
        found.setdefault((r.doc_id, r.bi), []).append(r.text)
    want = duck.execute(f"with {SQL['blocks']} select doc_id, bi, text from blocks where kind = 'paragraph'").fetchall()
    assert {(d, b): words(t) for d, b, t in want} == {k: [w for line in v for w in words(line)] for k, v in found.items()}


def test_blank_regions_hold_no_word(spark, duck):
    from leafmill.plans.views import SQL

    boxes = {}
    for d, p, *box in duck.execute(f"with {SQL['tok']}, {SQL['ocr']} select doc_id, page_index, x0, y0, x1, y1 from ocr where page_index % 2 = 0 or y0 % 600 >= 240").fetchall():
        boxes.setdefault((d, p), []).append(box)
    found = rows(spark, "w30_blank_regions")
    assert found
    for r in found:
        assert not any(x0 < r.x1 and r.x0 < x1 and y0 < r.y1 and r.y0 < y1 for x0, y0, x1, y1 in boxes[r.doc_id, r.page_index])
        assert (r.x1 - r.x0) * (r.y1 - r.y0) >= 0.08 * 1100 * 1200 - 1


def test_dropped_runs_add_up(spark):
    by = Counter()
    for r in rows(spark, "w06_dropped_runs"):
        assert r.n == len(words(r.words)) >= 2
        by[r.doc_id] += r.n
    assert by == {r.doc_id: r.n_words for r in rows(spark, "w06_dropped_totals")}


def test_replayed_books_keep_or_change_what_the_log_says(spark):
    found = rows(spark, "w13_apply_edits")
    assert found and all(r.text.strip() for r in found)
    places = Counter((r.doc_id, r.n) for r in found)
    assert max(places.values()) == 1 and all((d, n - 1) in places for d, n in places if n)


def test_notes_are_numbered_in_the_order_of_their_places(spark):
    by = {}
    for r in rows(spark, "w19_prepared_notes"):
        if r.mark is not None:
            by.setdefault(r.doc_id, []).append((r.mark, r.bi, r.word_index))
    assert by
    for marks in by.values():
        marks.sort()
        assert [m for m, _, _ in marks] == list(range(1, len(marks) + 1)) and [m[1:] for m in marks] == sorted(m[1:] for m in marks)


def test_pictures_lie_on_their_pages_and_folded_terms_are_entries(spark):
    assert all(r.count for r in rows(spark, "a01_lexicon_folded"))
    entries = {r.key for r in rows(spark, "a01_lexicon_entries")}
    assert {r.key for r in rows(spark, "a01_lexicon_folded")} <= entries
    assert rows(spark, "j14_illustrations")


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0)"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert out.stdout.strip() == "True"
