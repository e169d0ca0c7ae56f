"""Files and archives as Python data sources: a writer that leaves no half of anything, and a reader of EPUB archives.

Paths are URIs of any store that pyarrow knows, so that driver and executors see the same files.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Archives are dealt out so many bytes a task; a larger one is cut into ranges of entries.
BYTES = 8 << 20
#: Bytes of content, and rows, that a task reads before it hands them on.
BATCH, ROWS = 4 << 20, 1000
_PENDING = "_pending"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


# ---- writing --------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list


class _FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return f"{root}/{_PENDING}-{self.job}"

    def write(self, rows: Iterator) -> Written:
        """Each task writes into a folder of its own; a task that is run again takes another."""
        store, root = _store(self.path)
        folder, names = f"{self._pending(root)}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for row in rows:
            if not row["name"] or re.search(r"(^|/)\.\.?(/|$)|^/", row["name"]):
                raise ValueError(f"{row['name']!r} is not a file's name")
            where = f"{folder}/{row['name']}"
            store.create_dir(posixpath.dirname(where), recursive=True)
            with store.open_output_stream(where) as out:
                out.write(bytes(row["content"] or b""))
            names.append(row["name"])
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        """Files are moved to their names once all tasks are done; a name that two rows gave moves nothing."""
        store, root = _store(self.path)
        done = [m for m in messages if m is not None]
        twice = [n for n, k in Counter(n for m in done for n in m.names).items() if k > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"several rows are named {sorted(twice)[0]!r}")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if not info.base_name.startswith(_PENDING):
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        for folder in {posixpath.dirname(f"{root}/{name}") for m in done for name in m.names}:
            store.create_dir(folder, recursive=True)
        for m in done:
            for name in m.names:
                store.move(f"{m.folder}/{name}", f"{root}/{name}")
        store.delete_dir(self._pending(root)) if store.get_file_info(self._pending(root)).type == fs.FileType.Directory else None

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        if store.get_file_info(self._pending(root)).type == fs.FileType.Directory:
            store.delete_dir(self._pending(root))


class FilesSource(DataSource):
    """``df.write.format("leafmill_files").save(path)``: a file a row (name, content), all of them or none."""

    @classmethod
    def name(cls) -> str:
        return "leafmill_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> _FilesWriter:
        return _FilesWriter(self.options["path"], overwrite)


# ---- archives -------------------------------------------------------------------------------------------------------

ENTRIES = "archive string, kind string, page int, name string, media_type string, content binary, reason string"
_ARROW = pa.schema([("archive", pa.string()), ("kind", pa.string()), ("page", pa.int32()), ("name", pa.string()), ("media_type", pa.string()), ("content", pa.binary()), ("reason", pa.string())])


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that are closed once they hold ``BATCH`` bytes of content or ``ROWS`` rows; Spark's own hold 10,000 rows of any size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[5] or b"")
        if size >= BATCH or len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


def resolve(base: str, relative: str) -> str:
    """A reference's path in its archive, against the folder of the file that makes it."""
    path = relative.split("#")[0]
    whole = path if path.startswith("/") else posixpath.join(posixpath.dirname(base), path)
    parts: list[str] = []
    for part in whole.split("/"):
        if part == "..":
            parts[-1:] = []
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1] if isinstance(e.tag, str) else ""


def package(archive: zipfile.ZipFile) -> tuple[dict, list[tuple[str, str]], dict]:
    """(metadata, pages as (path, media type) in reading order, images as path to media type) that an archive's package states."""
    container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    where = next((e.get("full-path") for e in container.iter() if _tag(e) == "rootfile" and e.get("full-path")), None)
    if where is None:
        raise KeyError("the container names no package")
    root = ElementTree.fromstring(archive.read(where))
    text = lambda e: " ".join("".join(e.itertext()).split())
    said = {}
    for e in root.iter():
        if _tag(e) in ("title", "publisher", "language", "date") and text(e):
            said.setdefault(_tag(e), text(e))
    makers = [(next((v.lower() for k, v in e.attrib.items() if k.rsplit("}", 1)[-1].rsplit(":", 1)[-1] == "role"), ""), text(e)) for e in root.iter() if _tag(e) == "creator"]
    chosen = [t for r, t in makers if r == "aut"] or [t for r, t in makers if r == ""] or [t for _, t in makers]
    items = {e.get("id"): (resolve(where, e.get("href")), e.get("media-type", "")) for e in root.iter() if _tag(e) == "item" and e.get("id") and e.get("href")}
    refs = [e for e in root.iter() if _tag(e) == "itemref" and e.get("linear", "yes").lower() != "no"]
    year = re.search(r"\b(1[0-9]{3}|20[0-9]{2})\b", said.pop("date", ""))
    metadata = {"title": None, "publisher": None, "language": None} | said | {"author": (chosen or [""])[0] or None, "year": year[1] if year else None}
    return metadata, [items[e.get("idref")] for e in refs if e.get("idref") in items], {p: m for p, m in items.values() if m.startswith("image/")}


@dataclass
class Share(InputPartition):
    """Archives whole, or entries ``first`` to ``last`` of one."""

    paths: list
    first: int | None = None
    last: int | None = None

    def __post_init__(self):
        super().__init__(None)


class _ArchivesReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list:
        """Files are only listed here; of one larger than a share the directory at its end is read, to cut it by entries."""
        store, root = _store(self.path)
        one = store.get_file_info(root)
        files = [one] if one.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        shares, now, held = [], [], 0
        for f in sorted((f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            if f.size > self.size:
                shares += self._cut(store, f)
                continue
            if now and held + f.size > self.size:
                shares.append(Share(now))
                now, held = [], 0
            now.append(f.path)
            held += f.size
        return shares + [Share(now)] if now or not shares else shares

    def _cut(self, store, f) -> list:
        try:
            with store.open_input_file(f.path) as file, zipfile.ZipFile(file) as archive:
                sizes = [i.compress_size for i in archive.infolist()]
        except Exception:  # its reason is a row of the task that opens it
            return [Share([f.path])]
        out, first, held = [], 0, 0
        for k, n in enumerate(sizes):
            if k > first and held + n > self.size:
                out.append(Share([f.path], first, k))
                first, held = k, 0
            held += n
        return [*out, Share([f.path], first, len(sizes))]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        return batches(self._rows(share))

    def _rows(self, share: Share) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path in share.paths:
            name = posixpath.basename(path)
            try:
                with store.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                    yield from self._entries(name, archive, share.first, share.last)
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, OSError, ValueError, NotImplementedError, RuntimeError) as e:
                yield (name, "damage", None, None, None, None, f"{type(e).__name__}: {e}"[:200])

    def _entries(self, name: str, archive: zipfile.ZipFile, first: int | None, last: int | None) -> Iterator[tuple]:
        said, pages, images = package(archive)
        there = {i.filename: k for k, i in enumerate(archive.infolist())}
        mine = lambda k: first is None or first <= k < last
        if not first:
            for field, value in said.items():
                if value is not None:
                    yield (name, "metadata", None, field, None, value.encode(), None)
            for n, (path, media) in enumerate(pages):
                if path not in there:
                    yield (name, "page", n, path, media, None, "the archive has no such file")
        listed = [("page", n, *p) for n, p in enumerate(pages)] + [("image", None, p, m) for p, m in images.items()]
        for kind, n, path, media in listed:
            if path in there and mine(there[path]):
                try:
                    yield (name, kind, n, path, media, archive.read(path), None)
                except Exception as e:  # one damaged entry doesn't take the others with it
                    yield (name, kind, n, path, media, None, f"{type(e).__name__}: {e}"[:200])


class ArchivesSource(DataSource):
    """``spark.read.format("leafmill_epub").load(path)``: metadata, pages and images of the EPUB archives in a folder.

    An archive that can't be read is a row of kind damage with the reason; a page or image that can't has its reason and no
    content. Pages are numbered in reading order.
    """

    @classmethod
    def name(cls) -> str:
        return "leafmill_epub"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> _ArchivesReader:
        return _ArchivesReader(self.options["path"], int(self.options.get("share", BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FilesSource)
    spark.dataSource.register(ArchivesSource)
