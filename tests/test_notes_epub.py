import random
import re

from pyspark.sql import functions as F

from leafmill.operators import notes, pictures
from leafmill.sources import epub, files


RAISED = str.maketrans("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")


def pattern(marker):
    marker = (marker or "").strip()
    if not marker:
        return None
    if not re.fullmatch(r"[0-9]+", marker):
        return re.compile(re.escape(marker))
    return re.compile(rf"(?<![0-9]){marker}(?![0-9])|(?<![⁰¹²³⁴-⁹]){marker.translate(RAISED)}(?![⁰¹²³⁴-⁹])")


def fold(blocks, notes):
    """Placed notes (id, mark, block, word) block by block, each with all notes that still wait; and those left over."""
    waiting, placed = {n[0]: n for n in sorted(notes)}, []
    for bi, text in blocks:
        spots = []
        for order, (note, marker, home, at) in enumerate(waiting.values()):
            if home is not None:
                if home == bi:
                    where = max(0, min(len(text), at or 0))
                    spots.append((where, where, order, note))
            elif (p := pattern(marker)) and (m := p.search(text)):
                spots.append((m.start(), m.end(), order, note))
        left, at = "", 0
        for start, end, _, note in sorted(spots, key=lambda s: (s[0], s[1] - s[0], s[2])):
            if start >= at:
                left, at = left + text[at:start], end
                placed.append((note, len(placed) + 1, bi, max(0, len(left.split()) - 1)))
                del waiting[note]
    return placed, list(waiting)


def prepared(spark, docs):
    b = [(d, bi, t) for d, (blocks, _) in enumerate(docs) for bi, t in blocks]
    n = [(d, *x) for d, (_, notes_) in enumerate(docs) for x in notes_]
    got = notes.prepare(spark.createDataFrame(b, "doc_id long, bi long, text string"), spark.createDataFrame(n, "doc_id long, note_id string, marker string, home long, at int"))
    return sorted(tuple(r) for r in got.na.fill(-1).collect())


def test_markers(spark):
    def value(column, **row):
        return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("v")).first().v

    met = lambda text, marker: value(F.rlike(F.col("t"), notes.marker_pattern(F.col("m"))), t=text, m=marker)
    assert value(notes.marker_pattern(F.col("m")), m=" ") is None and met("a b* c", "*") and met("\\E", "\\E") and not met("a", "*")
    assert [met(t, "1") for t in ("a 1 b", "word¹.", "11 ¹² 21")] == [True, True, False]
    strip = lambda text, marker: value(notes.strip_marker(F.col("t"), F.col("m")), t=text, m=marker)
    assert strip(" 3) The note", "3") == "The note" and strip("³ The note", "3") == "The note" and strip("3. ", "3") == "3."
    assert strip("*", "*") == "*" and strip("** two", "*") == "** two" and strip("a note", None) == "a note"


def test_places(spark):
    blocks = [(0, "One word¹ and * more"), (1, "later 2 and ¹ again")]
    asked = [("a", "2", None, None), ("b", "1", None, None), ("c", "*", None, None), ("d", None, 0, 8), ("e", "9", None, None)]
    assert prepared(spark, [(blocks, asked)]) == [(0, "a", 4, 1, 0), (0, "b", 2, 0, 1), (0, "c", 3, 0, 2), (0, "d", 1, 0, 1), (0, "e", -1, -1, -1)]


def test_random_documents_equal_a_fold(spark):
    rng, docs = random.Random(7), []
    for _ in range(60):
        marks = ["1", "2", "12", "*", "**", "†", "a", "ab", "the", " ", None]
        blocks = [(k, " ".join(rng.choice(["the", "ab¹ b", "2", "12", "x**", "†*", "word²", "1", "¹²", "𝔘 *", "a"]) for _ in range(rng.randrange(9)))) for k in range(rng.randrange(1, 7))]
        asked = [(f"n{k}", rng.choice(marks), rng.choice([None, None, None, rng.randrange(7)]), rng.choice([None, rng.randrange(-2, 30)])) for k in range(rng.randrange(9))]
        docs.append((blocks, asked))
    want = []
    for d, (blocks, asked) in enumerate(docs):
        placed, orphans = fold(blocks, asked)
        want += [(d, *p) for p in placed] + [(d, n, -1, -1, -1) for n in orphans]
    assert prepared(spark, docs) == sorted(want)


def test_words_break_where_patterns_say(spark):
    from leafmill.operators import hyphens

    words = spark.createDataFrame([("hyphenation",), ("hyphenation",), ("Concat",), ("a",), ("",)], "word string")
    patterns = spark.createDataFrame([("hy3ph",), ("he2n",), ("hena4",), ("hen5at",), ("1na",), ("n2at",), ("1tio",), ("2io",), ("o2n",), (".con5c",)], "pattern string")
    broken = hyphens.breaks(words, patterns)
    got = {r.word: (r.at, r.parts) for r in broken.join(hyphens.parts(broken), "word").collect()}
    # The published example of the method: hy-phen-ation, its a-tion closed by the greater even digit.
    assert got["hyphenation"] == ([2, 6], ["hy", "phen", "ation"]) and got["Concat"] == ([3], ["Con", "cat"]) and got["a"] == ([], ["a"]) and got[""] == ([], [""])
    assert hyphens.breaks(words, patterns.limit(0)).where("size(at) > 0").count() == 0


def near(a, b, gap):
    return all(a[k] - gap <= b[k + 2] and b[k] - gap <= a[k + 2] for k in (0, 1))


def joined(boxes, gap):
    """Boxes joined two by two until no two are near."""
    now, again = list(boxes), True
    while again:
        again, out = False, []
        for box in now:
            for k, o in enumerate(out):
                if near(o, box, gap):
                    out[k], again = (min(o[0], box[0]), min(o[1], box[1]), max(o[2], box[2]), max(o[3], box[3])), True
                    break
            else:
                out.append(box)
        now = out
    return sorted(now)


def test_nearby_boxes_join_until_none_is_near(spark):
    rng, pages = random.Random(3), {}
    pages[0] = [(0.0, 0.0, 1.0, 1.0), (5.0, 0.0, 6.0, 1.0), (2.0, 0.0, 4.0, 1.0), (0.0, 0.0, 1.0, 1.0)]
    pages[1] = [(0.0, 0.0, 1.0, 1.0), (3.0, 3.0, 4.0, 4.0), (-9.0, -9.0, -8.0, -8.0)]
    pages[2] = [(x, y, x + rng.randrange(6), y + rng.randrange(6)) for x, y in ((rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(3000))]
    pages[3] = [(float(k), float(k % 7), k + 0.5, k % 7 + 0.5) for k in range(1500)]  # a row in which each only reaches the next
    rows = [(p, *map(float, b)) for p, boxes in pages.items() for b in boxes]
    got = {p: [] for p in pages}
    for r in pictures.merge_nearby(spark.createDataFrame(rows, "page long, x0 double, y0 double, x1 double, y1 double"), ["page"], 1.0).collect():
        got[r.page].append(tuple(r)[1:])
    assert got[0] == [(0, 0, 6, 1)] and len(got[1]) == 3
    assert {p: sorted(b) for p, b in got.items()} == {p: joined([tuple(map(float, x)) for x in b], 1.0) for p, b in pages.items()}


def test_illustrations_equal_a_fold(spark):
    rng, rows = random.Random(4), []
    for page in range(40):
        for n in range(rng.randrange(9)):
            x, y = rng.randrange(100), rng.randrange(100)
            rows.append((1, page, n, float(x), float(y), float(x + rng.randrange(1, 40)), float(y + rng.randrange(1, 40))))
    got = {}
    for r in pictures.illustrations(spark.createDataFrame(rows, pictures.REGIONS), 4).orderBy("page_index", "n").collect():
        got.setdefault(r.page_index, []).append(tuple(r)[3:])
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    shared = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    for page in range(40):
        kept = []
        for b in sorted((r[3:] for r in rows if r[1] == page), key=lambda b: (-size(b), b)):
            if all(shared(k, b) <= 0.35 * size(b) for k in kept):
                kept.append(b)
        assert got.get(page, []) == sorted(joined(kept, 4), key=lambda b: (-size(b), b))[:3]


def test_paths():
    assert files.resolve("OPS/text/a.xhtml", "../img/b.png#x") == "OPS/img/b.png"
    assert files.resolve("a.xhtml", "../../c") == "c" and files.resolve("OPS/a", "/d/./e") == "d/e"


def test_archives(spark, tmp_path):
    book = epub.write([("a.xhtml", "<p>one</p><h2>two</h2>"), ("b.xhtml", ""), ("c.xhtml", "three")], "A title", {"m.png": b"\x89PNG"})
    (tmp_path / "x.epub").write_bytes(book)
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    (tmp_path / "cut.epub").write_bytes(book[: len(book) // 2])
    (tmp_path / "empty.epub").write_bytes(b"")
    broken = bytearray(book)
    at = book.index(b"OPS/text/c.xhtml") + len("OPS/text/c.xhtml")
    broken[at + 2] ^= 0xFF  # inside the packed bytes of one page
    (tmp_path / "page.epub").write_bytes(bytes(broken))
    found = epub.entries(spark, f"file://{tmp_path}")
    damaged = {r.archive: r.reason for r in found.where("kind = 'damage'").collect()}
    assert set(damaged) == {"bad.epub", "cut.epub", "empty.epub"} and "BadZipFile" in damaged["cut.epub"] and all(damaged.values()), damaged
    (page,) = found.where("archive = 'page.epub' and kind = 'page' and page = 2").collect()
    assert page.content is None and page.reason
    got = sorted(tuple(r) for r in epub.pages(found.where("archive = 'x.epub'")).na.fill({"n": -1, "level": -1, "kind": "", "text": ""}).collect())
    assert got == [
        ("x.epub", 0, "OPS/text/a.xhtml", 0, "paragraph", 0, "one"), ("x.epub", 0, "OPS/text/a.xhtml", 1, "heading", 2, "two"),
        ("x.epub", 1, "OPS/text/b.xhtml", -1, "", -1, ""), ("x.epub", 2, "OPS/text/c.xhtml", 0, "paragraph", 0, "three"),
    ]
    assert {r.archive: r.title for r in epub.metadata(found).collect()} == {"x.epub": "A title", "page.epub": "A title"}
    assert [bytes(r.content) for r in found.where("archive = 'x.epub' and kind = 'image'").collect()] == [b"\x89PNG"]
    # A share smaller than an archive cuts it into ranges of entries: the same rows, in more partitions.
    cut = spark.read.format("leafmill_epub").option("share", 200).load(f"file://{tmp_path}/x.epub")
    rows = lambda df: sorted(((r.kind, r.page, r.name, r.reason) for r in df.where("archive = 'x.epub'").collect()), key=str)
    assert rows(cut) == rows(found) and cut.rdd.getNumPartitions() > 1
    assert epub.entries(spark, f"file://{tmp_path}/nothing").count() == 0


def test_packages_say_who_wrote_them():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<c><rootfile full-path="p.opf"/></c>')
        z.writestr("p.opf", '<package xmlns:dc="d" xmlns:opf="o"><dc:creator opf:role="trl">T</dc:creator><dc:creator>Plain</dc:creator><dc:creator opf:role="AUT"> The  Author </dc:creator><dc:date>made 1913-01-02</dc:date><dc:title/><dc:title>Real</dc:title>'
                            '<manifest><item id="a" href="x/../a.html"/></manifest><spine><itemref idref="a" linear="no"/><itemref idref="a"/></spine></package>')  # fmt: skip
    said, pages, _ = files.package(zipfile.ZipFile(out))
    assert (said["author"], said["year"], said["title"], said["publisher"]) == ("The Author", "1913", "Real", None) and pages == [("a.html", "")]


def test_files_are_written_all_or_none(spark, tmp_path):
    files.register(spark)
    path = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(f"d{k % 3}/f{k}.txt", bytearray(f"text {k}".encode())) for k in range(40)], "name string, content binary").repartition(4)
    rows.write.format("leafmill_files").mode("append").save(path)
    there = lambda: {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert there() == {f"d{k % 3}/f{k}.txt": f"text {k}" for k in range(40)}
    before = there()
    for bad in ("../up.txt", "d0/f0.txt"):
        more = rows.limit(20).union(spark.createDataFrame([(bad, bytearray(b"x"))] * 2, "name string, content binary"))
        try:
            more.write.format("leafmill_files").mode("append").save(path)
            raise AssertionError("such rows must not be written")
        except Exception as e:
            assert "AssertionError" not in type(e).__name__
        assert there() == before and not list((tmp_path / "out").glob("_pending*"))
    rows.limit(1).write.format("leafmill_files").mode("overwrite").save(path)
    assert len(there()) == 1
