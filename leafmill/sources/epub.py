"""Books as EPUB archives: their pages as typed blocks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .html import walk

PAGES = "path string, page_index int, href string, n int, kind string, level int, text string"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``files.ArchivesSource`` for the archives under ``path``."""
    files.register(spark)
    return spark.read.format("leafmill_epub").load(path)


def metadata(found: DataFrame) -> DataFrame:
    """archive, title, author, year, publisher, language of each archive that could be read."""
    fields = ("title", "author", "year", "publisher", "language")
    said = lambda f: F.when((F.col("kind") == "metadata") & (F.col("name") == f), F.decode("content", "UTF-8"))
    return found.where("kind <> 'damage'").groupBy("archive").agg(*(F.max(said(f)).alias(f) for f in fields))


def pages(found: DataFrame) -> DataFrame:
    """path, page_index, href, n, kind, level, text of the blocks of each page of ``entries``.

    A page whose file is missing or empty stays, as one row without a block, so that pages keep their numbers.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for archive, page, name, content in zip(frame["archive"], frame["page"], frame["name"], frame["content"]):
                blocks = walk(bytes(content).decode("utf-8", "replace")) if content is not None else []
                rows += [(archive, page, name, n, *b) for n, b in enumerate(blocks)] or [(archive, page, name, None, None, None, None)]
            yield pd.DataFrame(rows, columns=["path", "page_index", "href", "n", "kind", "level", "text"]).astype({"n": "Int32", "level": "Int32"})

    return found.where("kind = 'page'").select("archive", "page", "name", "content").mapInPandas(run, PAGES)


def write(pages: list[tuple[str, str]], title: str | None = None, images: dict | None = None) -> bytes:
    """A small archive of pages (name, html)."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="text/{n}" media-type="application/xhtml+xml"/>' for k, (n, _) in enumerate(pages))
        items += "".join(f'<item id="m{k}" href="img/{n}" media-type="image/png"/>' for k, n in enumerate(images or {}))
        refs = "".join(f'<itemref idref="i{k}"/>' for k in range(len(pages)))
        about = f"<metadata><title>{title}</title></metadata>" if title else ""
        z.writestr("OPS/book.opf", f"<package>{about}<manifest>{items}</manifest><spine>{refs}<itemref idref='gone'/></spine></package>")
        for name, html in pages:
            if html:
                z.writestr(f"OPS/text/{name}", html)
        for name, data in (images or {}).items():
            z.writestr(f"OPS/img/{name}", data)
    return out.getvalue()
