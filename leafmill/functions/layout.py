"""Column functions on page geometry and print checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = 72
LEADING = 1.32
# Page sizes that the printer takes, in inches.
TRIMS = [
    (5.0, 8.0), (5.06, 7.81), (5.25, 8.0), (5.5, 8.5), (6.0, 9.0), (6.14, 9.21), (6.69, 9.61), (7.0, 10.0),
    (7.44, 9.69), (7.5, 9.25), (8.0, 10.0), (8.25, 11.0), (8.5, 11.0),
]
# Most pages for an inside margin, in inches.
GUTTERS = [(150, 0.375), (300, 0.5), (500, 0.625), (700, 0.75)]
WIDEST_GUTTER = 0.875


def effective_dpi(pixels: Column, inches: Column) -> Column:
    return F.when(inches <= 0, 0.0).otherwise(pixels / inches)


def dpi_status(dpi: Column, target: float = 300) -> Column:
    return F.when(dpi >= target, "ok").otherwise("warn")


def least_gutter(pages: Column) -> Column:
    out = F.lit(WIDEST_GUTTER)
    for most, inches in reversed(GUTTERS):
        out = F.when(pages <= most, inches).otherwise(out)
    return out


def trim_points(token: Column, side: int) -> Column:
    """Width (side 1) or height (2) of a size such as 6x9, in points; 6 by 9 inches where it isn't one."""
    pattern = r"(?i)^\s*(\d+(?:\.\d+)?)\s*[x×]\s*(\d+(?:\.\d+)?)\s*$"
    values = [F.expr("try_cast(null as double)")] + [F.regexp_extract(token, pattern, k).try_cast("double") for k in (1, 2)]
    ok = F.coalesce((values[1] > 0) & (values[2] > 0), F.lit(False))
    return F.when(ok, values[side]).otherwise(6.0 if side == 1 else 9.0) * POINTS


def frame(token: Column, inner: Column, outer: Column, top: Column, bottom: Column, gutter: Column, recto: Column) -> Column:
    """The text frame of a page side, in points."""
    near = (inner + gutter) * POINTS
    return F.struct(
        F.when(recto, near).otherwise(outer * POINTS).alias("x"),
        (top * POINTS).alias("y"),
        F.greatest(F.lit(1.0), trim_points(token, 1) - near - outer * POINTS).alias("width"),
        F.greatest(F.lit(1.0), trim_points(token, 2) - (top + bottom) * POINTS).alias("height"),
    )


def leading(size: Column) -> Column:
    return size * LEADING


def lines_per_frame(height: Column, lead: Column, ascent: Column) -> Column:
    return F.when(lead <= 0, 0).otherwise(F.greatest(F.lit(0), F.floor((height - ascent) / lead) + 1)).cast("long")


def known_trim(token: Column) -> Column:
    w, h = trim_points(token, 1) / POINTS, trim_points(token, 2) / POINTS
    return F.exists(
        F.array(*[F.struct(F.lit(a).alias("w"), F.lit(b).alias("h")) for a, b in TRIMS]),
        lambda t: (F.abs(w - t["w"]) < 0.02) & (F.abs(h - t["h"]) < 0.02),
    )


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0), x1 - x0) * F.greatest(F.lit(0), y1 - y0)


def overlap_area(a: Column, b: Column) -> Column:
    """Shared area of two boxes (structs of x0, y0, x1, y1)."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w <= 0) | (h <= 0), 0).otherwise(w * h)


LEAST_DPI = 300
CHECKS = "array<struct<id:string,level:string,detail:string>>"


def print_checks(trim: Column, pages: Column, inside: Column, dpi: Column, warnings: Column, typeset: Column, embedded: Column) -> Column:
    """The six checks of a book for print, in order, as id, level and detail: its fonts, page size, inside margin (margin and
    gutter together), pictures (array of dots an inch, null where unknown), lines that ran over, and pages."""
    w, h = (trim_points(trim, k) / POINTS for k in (1, 2))
    inches = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    known, need = known_trim(trim), least_gutter(pages)
    wide = inside >= need - 1e-9
    size = said("Trim ", trim, " (", inches(w), "×", inches(h), " in) ")
    margin = said("Inside margin ", F.format_string("%.3f", inside))
    low, unknown = F.size(F.filter(dpi, lambda d: d < LEAST_DPI)), F.size(F.filter(dpi, lambda d: d.isNull()))
    n = F.size(dpi)
    # Fixed wording.
    rows = [
        ("fonts-embedded", F.when(embedded, "ok").otherwise("warn"), F.when(embedded, "The typeface is embedded in the PDF, so the book sets the same everywhere.").otherwise("Fonts may not be fully embedded — KDP requires embedded fonts.")),
        ("trim-size", F.when(known, "ok").otherwise("warn"), F.when(known, said(size, "is a recognized KDP size.")).otherwise(said(size, "is not a standard KDP size; confirm it is supported."))),
        (
            "gutter", F.when(wide, "ok").otherwise("fail"),
            F.when(wide, said(margin, " in meets the ", need, " in minimum for ", pages, " pages.")).otherwise(said(margin, " in is below the ", need, " in minimum for ", pages, " pages; text may be swallowed by the spine.")),
        ),
        (
            "image-dpi", F.when((low > 0) | (unknown > 0), "warn").otherwise("ok"),
            F.when(n == 0, "No placed images to check.").when(low > 0, said(low, " image(s) below 300 DPI at placed size and may print muddy."))
            .when(unknown > 0, said(unknown, " image(s) have unknown effective DPI; verify they meet 300 DPI.")).otherwise(said("All ", n, " image(s) meet 300 DPI at placed size.")),
        ),
        (
            "latex-warnings", F.when(~typeset, "pending").when(warnings > 0, "warn").otherwise("ok"),
            F.when(~typeset, "Not checked yet — these only exist once the book has been typeset.").when(warnings > 0, said(warnings, " line(s) run past the margin and need resolving or acknowledging.")).otherwise("Every line fits its measure."),
        ),
        (
            "page-count", F.when(typeset, "ok").otherwise("pending"),
            F.when(typeset, said("Final interior page count: ", pages, " pages (use for cover spine width).")).otherwise(said("Roughly ", pages, " pages, based on the scan. Typeset the book before sizing the cover spine — the real count will differ.")),
        ),
    ]
    return F.array(*(F.struct(F.lit(i).alias("id"), level.alias("level"), detail.alias("detail")) for i, level, detail in rows)).cast(CHECKS)
