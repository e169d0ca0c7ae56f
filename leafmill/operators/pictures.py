"""Pictures in tables: operations on them, their sizes, and the parts of pages without words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.images import apply_ops, luma, size_after
from ..plans import scratch

EDITED = "picture_id long, width int, height int, pixels binary, expected_width int, expected_height int"


def edit(pictures: DataFrame) -> DataFrame:
    """picture_id, width, height, pixels after each picture's ops (array of name, params), and the size known beforehand.

    Pictures: picture_id, width, height, pixels (RGBA bytes), ops.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                ops = [(o["op"], dict(o["params"] or {})) for o in (r.ops if r.ops is not None else [])]
                img = np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 4)
                out = apply_ops(img, ops)
                rows.append((r.picture_id, out.shape[1], out.shape[0], out.tobytes(), *size_after(r.width, r.height, ops)))
            yield pd.DataFrame(rows, columns=["picture_id", "width", "height", "pixels", "expected_width", "expected_height"])

    return pictures.select("picture_id", "width", "height", "pixels", "ops").mapInPandas(run, EDITED)


def ink(img: np.ndarray) -> tuple[float, tuple[int, int, int, int] | None]:
    """The share of ink (darker than the paper, the tone below which nine tenths lie, by 45) and its box."""
    grey = np.sort(luma(img).ravel())
    dark = luma(img) < grey[int(0.9 * len(grey))] - 45
    if not dark.any():
        return 0.0, None
    y, x = np.nonzero(dark)
    return float(dark.mean()), (int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1)


REGIONS = "doc_id long, page_index long, n int, x0 double, y0 double, x1 double, y1 double"


def empty_rectangles(taken: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Maximal free rectangles (top, left, bottom, right) of a grid, by the heights of free columns above each row."""
    rows, cols = taken.shape
    full = taken.tolist()
    heights, out = [0] * (cols + 1), set()
    for r in range(rows):
        heights[:cols] = [0 if t else h + 1 for t, h in zip(full[r], heights)]
        stack: list[tuple[int, int]] = []
        for c in range(cols + 1):
            left = c
            while stack and stack[-1][1] >= heights[c]:
                start, height = stack.pop()
                if height > heights[c]:
                    grows = r + 1 < rows and not any(full[r + 1][start:c])
                    if not grows:
                        out.add((r - height + 1, start, r + 1, c))
                left = start
            if heights[c]:
                stack.append((left, heights[c]))
    return sorted(out)


def blank_regions(words: DataFrame, width: float, height: float, least: float = 0.08, grid: int = 32) -> DataFrame:
    """The large parts of each page (doc_id, page_index) that no word box touches and that aren't plain margins.

    A page is a whole number of bits for each row of its grid (62 columns at most), so its words never leave Spark.
    """
    if grid > 62:
        raise ValueError("a row of the grid has 62 columns at most")

    def page(taken: np.ndarray) -> list[tuple[float, float, float, float]]:
        inner = taken.any(1).nonzero()[0], taken.any(0).nonzero()[0]
        found = []
        for t, left, b, r in empty_rectangles(taken):
            margin = len(inner[0]) and (b <= inner[0][0] or t > inner[0][-1] or r <= inner[1][0] or left > inner[1][-1])
            if (b - t) * (r - left) >= least * grid * grid and not margin:
                found.append((t, left, b, r))
        found.sort(key=lambda x: (-(x[2] - x[0]) * (x[3] - x[1]), x))
        kept: list[tuple[int, int, int, int]] = []
        for x in found:
            if not any(k[0] <= x[0] and k[1] <= x[1] and k[2] >= x[2] and k[3] >= x[3] for k in kept):
                kept.append(x)
        return [(left * width / grid, t * height / grid, r * width / grid, b * height / grid) for t, left, b, r in kept]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, index, rows in zip(frame["doc_id"], frame["page_index"], frame["rows"]):
                taken = (np.asarray(rows, np.int64)[:, None] >> np.arange(grid) & 1).astype(bool)
                out += [(doc, index, n, *box) for n, box in enumerate(page(taken))]
            yield pd.DataFrame(out, columns=["doc_id", "page_index", "n", "x0", "y0", "x1", "y1"])

    cell = lambda at: F.greatest(F.lit(0), F.least(F.lit(grid), at)).cast("int")
    a, b = cell(F.floor(F.col("x0") * grid / width)), cell(F.ceil(F.col("x1") * grid / width))
    c, d = cell(F.floor(F.col("y0") * grid / height)), cell(F.ceil(F.col("y1") * grid / height))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    boxes = words.select("doc_id", "page_index", F.greatest(F.lit(0).cast("long"), bit(b) - bit(a)).alias("bits"), c.alias("c"), d.alias("d"))
    row = lambda k: F.bit_or(F.when((F.col("c") <= k) & (F.col("d") > k), F.col("bits")).otherwise(F.lit(0).cast("long"))).alias(f"r{k}")
    pages = boxes.groupBy("doc_id", "page_index").agg(*(row(k) for k in range(grid)))
    return pages.select("doc_id", "page_index", F.array(*(f"r{k}" for k in range(grid))).alias("rows")).mapInPandas(run, REGIONS)


def _named(now: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """``now`` (keys, id, x0, y0, x1, y1) with ``to``: the least id of the boxes near to each.

    Cells are many times the boxes, which Spark can't know beforehand: neither side of their join may be sent whole to all.
    """
    side = ["x0", "y0", "x1", "y1"]
    at = lambda c: F.floor(F.col(c) / gap).cast("long")
    cells = now.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    first = cells.groupBy(*keys, "cx", "cy").agg(F.min(F.struct("id", *side)).alias("b"))
    near = [F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    around = first.select(*keys, "b", F.inline(F.array(*near)))
    reach = [f"{a}0 - {gap} <= b.{a}1 and b.{a}0 - {gap} <= {a}1" for a in "xy"]
    return cells.join(around.hint("merge"), [*keys, "cx", "cy"]).where(" and ".join(reach)).groupBy(*keys, "id", *side).agg(F.min("b.id").alias("to"))


#: Boxes of one key that are joined in one task's memory; those of a more crowded key meet on cells.
TOGETHER = 1000


def joined(boxes: np.ndarray, gap: float) -> np.ndarray:
    """``boxes`` (a row: x0, y0, x1, y1) joined while any two are within ``gap``: a box that has grown is held against all others."""
    k = 0
    while k < len(boxes) > 1:
        box = boxes[k]
        near = ((boxes[:, :2] - gap <= box[2:]) & (box[:2] - gap <= boxes[:, 2:])).all(1)
        near[k] = True
        if near.sum() == 1:
            k += 1
            continue
        some = boxes[near]
        near[k] = False
        k, boxes = k - int(near[:k].sum()), boxes[~near]
        boxes[k] = [*some[:, :2].min(0), *some[:, 2:].max(0)]
    return boxes


def _joined_lists(listed: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """keys, x0, y0, x1, y1: each row's boxes (l, an array) ``joined``."""
    side = ["x0", "y0", "x1", "y1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            l = batch["l"]
            ends, flat = l.offsets.to_pylist(), np.stack([l.values.field(c).to_numpy(zero_copy_only=False) for c in side], 1)
            found = [joined(flat[a:z], gap) for a, z in zip(ends, ends[1:])]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            rows = np.concatenate([np.empty((0, 4)), *found])
            yield pa.RecordBatch.from_arrays([*(batch[k].take(at) for k in keys), *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], [*keys, *side])

    return listed.mapInArrow(run, T.StructType([*(listed.schema[k] for k in keys), *(T.StructField(c, T.DoubleType()) for c in side)]))


def merge_nearby(boxes: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """keys, x0, y0, x1, y1: ``boxes`` joined while any two of one key are within ``gap`` (above 0) of each other on both
    axes; a joined box may reach further ones.

    Boxes of one key are joined where they lie, as an array; only keys of more than ``TOGETHER`` boxes go by cells, whose rows
    are many times the boxes.
    """
    side = ["x0", "y0", "x1", "y1"]
    now = scratch.keep(boxes.select(*keys, *(F.col(c).cast("double").alias(c) for c in side)))
    crowded = scratch.keep(now.groupBy(*keys).count().where(F.col("count") > TOGETHER).select(*keys))
    together = lambda rows: _joined_lists(rows.groupBy(*keys).agg(F.collect_list(F.struct(*side)).alias("l")), keys, gap)
    if crowded.isEmpty():
        scratch.drop(crowded)
        return together(now)
    return together(now.join(crowded, keys, "left_anti")).unionByName(_joined_on_cells(now.join(crowded, keys, "left_semi"), keys, gap))


def _joined_on_cells(boxes: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """``merge_nearby`` of keys of any number of boxes.

    Boxes lie on cells of the size of the gap, so that all on one cell are near and those near lie on neighbouring cells.
    Each round a box takes the least name of what it is near to, by way of one box a cell, and boxes of one name become
    one: no two boxes are compared because they crowd in a place. Names are hashes, so a row of boxes halves each round.
    """
    side = ["x0", "y0", "x1", "y1"]
    now = scratch.keep(boxes.select(*keys, *side, F.xxhash64(F.monotonically_increasing_id()).alias("id")))
    while True:
        named = scratch.keep(_named(now, keys, gap))
        scratch.drop(now)
        now = scratch.keep(named.groupBy(*keys, F.col("to").alias("id")).agg(*(F.min(c).alias(c) for c in side[:2]), *(F.max(c).alias(c) for c in side[2:])))
        if named.where("to <> id").isEmpty():
            return now.select(*keys, *side)
        scratch.drop(named)


def suppressed(regions: DataFrame, keys: list[str], overlap: float) -> DataFrame:
    """keys, x0, y0, x1, y1 of the regions without those that a larger one that stays covers by ``overlap`` of their area."""
    box = "struct<less:double,x0:double,y0:double,x1:double,y1:double>"
    row = F.struct((-(F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("less"), "x0", "y0", "x1", "y1").cast(box)
    span = lambda a, b, c: F.greatest(F.lit(0.0), F.least(a[c + "1"], b[c + "1"]) - F.greatest(a[c + "0"], b[c + "0"]))
    hidden = lambda kept, b: F.exists(kept, lambda k: span(k, b, "x") * span(k, b, "y") > -overlap * b["less"])
    kept = F.aggregate("l", F.array().cast(f"array<{box}>"), lambda s, b: F.when(hidden(s, b), s).otherwise(F.concat(s, F.array(b))))
    return regions.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("l")).select(*keys, F.inline(kept)).drop("less")


def illustrations(regions: DataFrame, gap: float, most: int = 3, overlap: float = 0.35) -> DataFrame:
    """The few large picture regions of each page (doc_id, page_index, n, x0, y0, x1, y1): those that a larger one covers
    by ``overlap`` of their area go, near ones join."""
    keys = ["doc_id", "page_index"]
    found = merge_nearby(suppressed(regions, keys, overlap), keys, gap)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.expr("(x1 - x0) * (y1 - y0)")), "x0", "y0", "x1", "y1")
    return found.withColumn("n", F.row_number().over(order) - 1).where(F.col("n") < most).select(*keys, "n", "x0", "y0", "x1", "y1")
