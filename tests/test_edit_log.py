"""The edit log against a plain fold over random logs, and pinned pictures before and after splits and merges."""

import random

import pytest

from leafmill.operators import edits

BLOCKS = "doc_id long, bi long, id string, kind string, text string, level int"
LOG = "doc_id long, seq long, kind string, target string, value string, at int, level int, block_id string"


def fold(rows, log):
    """(blocks, anchors) by going through the log once, with every anchor so far renamed as blocks are."""
    now, pins = [dict(zip(("id", "kind", "level", "text", "sources"), (r[2], r[3], r[5], r[4], [r[1] // 4]))) for r in rows], {}

    def rename(old, new):
        for k, v in pins.items():
            if v == old:
                pins[k] = new

    for _, _, kind, target, value, at, level, block in log:
        if kind == "anchor":
            pins[target] = block
        k = next((k for k, b in enumerate(now) if b["id"] == target), None)
        if k is None or kind == "anchor":
            continue
        b = now[k]
        if kind == "text":
            b["text"] = value
        elif kind == "retype":
            b["kind"], b["level"] = value, (level or b["level"] or 1) if value == "heading" else None
        elif kind == "drop":
            del now[k]
        elif kind == "split":
            left, right = b["text"][: max(0, at)].strip(), b["text"][max(0, at) :].strip()
            if left and right:
                now[k : k + 1] = [b | {"id": b["id"] + "/1", "text": left}, b | {"id": b["id"] + "/2", "text": right}]
                rename(b["id"], b["id"] + "/2")
        elif kind == "merge" and k + 1 < len(now):
            other = now.pop(k + 1)
            b["text"] = (b["text"].strip() + ("\n" if "table" in (b["kind"], other["kind"]) else " ") + other["text"].strip()).strip()
            b["sources"] = sorted({*b["sources"], *other["sources"]})
            rename(other["id"], b["id"])
    return [b for b in now if b["text"].strip()], pins


@pytest.mark.parametrize("seed", range(3))
def test_random_logs_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(d, k, f"b{k}", rng.choice(["paragraph", "table", "heading"]), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 8))), rng.choice([None, 2])) for d in range(25) for k in range(rng.randrange(1, 6))]
    log = []
    for d in range(25):
        for seq in range(rng.randrange(25)):
            name = f"b{rng.randrange(5)}" + "".join(rng.choice(["/1", "/2"]) for _ in range(rng.choice([0, 0, 1, 2])))
            kind = rng.choice(["text", "retype", "drop", "split", "split", "merge", "merge", "anchor", "anchor", "retouch"])
            value = rng.choice(["heading", "caption", "table"]) if kind == "retype" else rng.choice(["new words for it", " ", "x"])
            target = f"pic{rng.randrange(6)}" if kind == "anchor" else name
            log.append((d, seq, kind, target, value, rng.randrange(-2, 20), rng.choice([None, 3]), rng.choice([name, name, None]) if kind == "anchor" else None))
    blocks, log_df = spark.createDataFrame(rows, BLOCKS), spark.createDataFrame(log, LOG)
    books = edits.replayed(blocks, log_df)
    got, pins = {}, {}
    for r in edits.kept_blocks(books).orderBy("doc_id", "n").collect():
        got.setdefault(r.doc_id, []).append(r.asDict())
    for r in edits.follow(log_df, edits.renames(books)).where("kind = 'anchor'").orderBy("seq").collect():
        pins.setdefault(r.doc_id, {})[r.target] = r.block_id
    for d in range(25):
        want, moved = fold([r for r in rows if r[0] == d], [e for e in log if e[0] == d])
        assert [{k: b[k] for k in ("id", "kind", "level", "text", "sources")} for b in got.get(d, [])] == want
        assert pins.get(d, {}) == moved


def test_pictures_stay_behind_their_words(spark):
    blocks = spark.createDataFrame([(1, k, f"b{k}", "paragraph", t, None) for k, t in enumerate(["one two", "three", "four"])], BLOCKS)
    edit = lambda seq, kind, target, at=0, block=None: (1, seq, kind, target, "", at, None, block)
    log = [edit(1, "anchor", "early", block="b0"), edit(2, "split", "b0", 3), edit(3, "anchor", "late", block="b0"), edit(4, "anchor", "next", block="b1"), edit(5, "merge", "b0/2"), edit(6, "merge", "b0/1"), edit(7, "anchor", "front"), edit(8, "split", "b0/1", 3), edit(9, "drop", "b2")]
    books = edits.replayed(blocks, spark.createDataFrame(log, LOG))
    assert [(r.id, r.text) for r in edits.kept_blocks(books).orderBy("n").collect()] == [("b0/1/1", "one"), ("b0/1/2", "two three")]
    found = {r.target: r.block_id for r in edits.follow(spark.createDataFrame(log, LOG), edits.renames(books)).where("kind = 'anchor'").collect()}
    # "late" names a block that was gone by then; the others follow two merges and a split, or stand in front.
    assert found == {"early": "b0/1/2", "late": "b0", "next": "b0/1/2", "front": None}


def test_no_edits_and_no_blocks(spark):
    blocks, none = spark.createDataFrame([(1, 0, "b0", "paragraph", "x", None)], BLOCKS), spark.createDataFrame([], LOG)
    assert edits.apply_edits(blocks, none).count() == 1 and edits.apply_edits(blocks.limit(0), none).count() == 0
    assert edits.follow(none, edits.renames(edits.replayed(blocks, none))).count() == 0


def test_splits_and_merges_strip_what_is_asked(spark):
    """A table's joined rows cut at their line end: the SQL's trim leaves it, the default takes it off."""
    rows = [(0, 0, "a", "table", "one", None), (0, 1, "b", "table", "two", None)]
    log = [(0, 0, "merge", "a", None, 0, None, None), (0, 1, "split", "a", None, 4, None, None)]
    found = lambda *blank: [r.text for r in edits.apply_edits(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame(log, LOG), *blank).orderBy("n").collect()]
    assert found(" ") == ["one\n", "two"] and found() == ["one", "two"]
