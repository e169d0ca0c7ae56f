"""A book of few pages: what goes on, what doesn't, and where pictures, notes and headings go."""

from leafmill.operators import binding

PAGES = "book long, page_index long, role string"
BLOCKS = "book long, page_index long, bi long, kind string, text string, level int, continues_next boolean, continues_previous boolean, marker string"


def block(page, bi, text, kind="paragraph", level=None, on=None, back=None, marker=None):
    return (1, page, bi, kind, text, level, on, back, marker)


def frames(spark, roles, rows, excluded=(), pictures=()):
    pages = binding.sorted_pages(spark.createDataFrame([(1, k, r) for k, r in enumerate(roles)], PAGES), spark.createDataFrame([(1, p) for p in excluded], "book long, page_index long"))
    return pages, spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([(1, p, n, f"i{p}_{n}") for p, n in pictures], "book long, page_index long, n int, picture_id string")


def flow(spark, *how, **more):
    return [(r.target, r.id, r.text, r.pages) for r in binding.bound(*frames(spark, *how, **more)).orderBy("target", "place").collect()]


def test_paragraphs_go_on_across_blank_pages_but_not_across_pages_left_out(spark):
    rows = [block(0, 0, "It began and"), block(2, 0, "went on, half-"), block(3, 0, "way there."), block(4, 0, "and more")]
    roles = ["body", "blank", "body", "body", "body"]
    assert flow(spark, roles, rows) == [("body", "p0b0", "It began and went on, halfway there.", [0, 2, 3]), ("body", "p4b0", "and more", [4])]
    assert flow(spark, roles, rows, excluded=[2]) == [("body", "p0b0", "It began and", [0]), ("body", "p3b0", "way there.", [3]), ("body", "p4b0", "and more", [4])]
    assert [(r.page_index, r.reason) for r in binding.skipped(frames(spark, roles, rows, excluded=[2])[0]).orderBy("page_index").collect()] == [(1, binding.REMADE), (2, binding.LEFT_OUT)]


def test_flags_join_what_the_text_would_not(spark):
    rows = [block(0, 0, "A full stop.", on=True), block(1, 0, "Then more."), block(1, 1, "New."), block(1, 2, "Said to go on", back=True), block(1, 3, "A verse", "verse", on=True), block(2, 0, "of a song", "verse"), block(2, 1, "", on=True)]
    got = [t for _, _, t, _ in flow(spark, ["body"] * 3, rows)]
    assert got == ["A full stop. Then more.", "New. Said to go on", "A verse of a song", ""]
    # An excluded page ends what was to go on; only the first block behind it can't say that it goes on either.
    rows = [block(0, 0, "One", on=True), block(2, 0, "two", back=True), block(2, 1, "three", back=True)]
    assert [t for _, _, t, _ in flow(spark, ["body"] * 3, rows, excluded=[1])] == ["One", "two three"]


def test_asides_stand_apart(spark):
    rows = [block(0, 0, "The text runs"), block(1, 0, "to my wife"), block(2, 0, "on here.")]
    assert flow(spark, ["body", "dedication", "body"], rows) == [("aside", "p1b0", "to my wife", [1]), ("body", "p0b0", "The text runs on here.", [0, 2])]


def test_pictures_take_captions_and_notes_are_numbered(spark):
    rows = [block(0, 0, "Fig. 1", "caption"), block(0, 1, "See here¹ and there.", "paragraph"), block(0, 2, "1. See Croll.", "footnote", marker="1"), block(0, 3, "Fig. 2", "caption"), block(0, 4, "no mark", "footnote")]
    rows += [block(1, 0, "* at home", "footnote", marker="*"), block(1, 1, "Title", "heading", level=2), block(2, 0, "dropped", "footnote", marker="1")]
    pages, blocks, pictures = frames(spark, ["body", "body", "index"], rows, pictures=[(0, 0), (1, 0), (2, 0)])
    assert [tuple(r)[2:] for r in binding.captioned(pages, blocks, pictures).orderBy("page_index").collect()] == [("i0_0", "Fig. 1"), ("i1_0", None)]
    found = binding.bound(pages, blocks, pictures)
    assert [r.text for r in found.where("kind = 'caption'").collect()] == ["Fig. 2"]
    assert [tuple(r)[1:] for r in binding.book_notes(pages, blocks, found).orderBy("note_id").collect()] == [("fn1", 0, "1", "See Croll.", False), ("fn2", 0, "*", "no mark", True), ("fn3", 1, "*", "at home", True)]
    assert [tuple(r)[1:] for r in binding.contents(found).collect()] == [("p1b1", "Title", 2, 2, 1)]
