"""Readers of feeds, sitemaps and JSON listings for ``spark.read`` and ``spark.readStream``.

After ``register(spark)`` the formats ``attestry_feed``, ``attestry_sitemap`` and
``attestry_listing`` read folders of files with one document a line, in any store that
pyarrow's file systems know.  All give the same columns: file, line, pos (of the item in its
document), title, link, published, and problem, which is null for an item.

Files are dealt to tasks by bytes and read line by line, so a task holds one document at a
time.  Filters on ``file`` decide which files are opened at all, those on ``link`` which items
leave the reader; others stay with Spark.  As a stream, files are taken in order of their
names, and the offset is the last name taken: started again, a query goes on behind it.

Defined cases: a line that can't be parsed becomes a row with a problem and no item, and so does
a file that can't be read; empty lines and files give nothing; a document without items gives
nothing; items lack what they do not say; hidden and unfinished files (names with a leading
dot or underscore) are not seen.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains

COLUMNS = "file string, line long, pos long, title string, link string, published string, problem string"
BYTES_PER_TASK = 1 << 23

Item = tuple[str | None, str | None, str | None]


def _said(node, *names: str) -> str | None:
    for name in names:
        found = node.find(f"{{*}}{name}")
        if found is not None and (text := "".join(found.itertext()).strip()):
            return text
    return None


def feed_items(text: str) -> list[Item]:
    """(title, link, day) of the items of an RSS feed or the entries of an Atom feed."""
    root, out = ElementTree.fromstring(text), []
    for node in root.iterfind(".//{*}item"):
        out.append((_said(node, "title"), _said(node, "link"), _said(node, "pubDate", "date")))
    for node in root.iterfind(".//{*}entry"):
        links = node.findall("{*}link")
        own = next((x for x in links if x.get("rel", "alternate") == "alternate"), None)
        out.append((_said(node, "title"), None if own is None else own.get("href"), _said(node, "published", "updated")))
    return out


def sitemap_items(text: str) -> list[Item]:
    """(title, address, day): the title is read off the last part of the address."""
    out = []
    for node in ElementTree.fromstring(text).iterfind(".//{*}url"):
        if link := _said(node, "loc"):
            last = re.search(r"/([^/?#]+)/?(?:[?#].*)?$", link.partition("://")[2])
            words = re.split(r"[-_]+", last[1]) if last else []
            out.append((" ".join(w.capitalize() for w in words) or None, link, _said(node, "lastmod")))
    return out


def listing_items(text: str) -> list[Item]:
    """(title, link, day) of the rows of a JSON listing that have an id and a title."""
    rows = json.loads(text)["data"]
    return [(r["title"].strip(), r.get("url") or str(r["id"]), r.get("date")) for r in rows if r.get("id") is not None and (r.get("title") or "").strip()]


PARSERS = {"feed": feed_items, "sitemap": sitemap_items, "listing": listing_items}


class Files(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class Folder:
    """The files of a folder, and the rows of some of them."""

    def __init__(self, kind: str, path: str, task_bytes: int):
        self.kind, self.path, self.task_bytes = kind, path, task_bytes
        self.file, self.parts = None, []

    def keep(self, names: set[str]) -> None:
        self.file = names if self.file is None else self.file & names

    def listed(self) -> list[tuple[str, int]]:
        """(name, bytes) of the files in order of their names."""
        store, inside = FileSystem.from_uri(self.path)
        found = store.get_file_info(FileSelector(inside, recursive=False, allow_not_found=True))
        return sorted((f.base_name, f.size or 0) for f in found if f.type == FileType.File and f.base_name[0] not in "._")

    def dealt(self, files: list[tuple[str, int]]) -> list[Files]:
        out, held = [], 0
        for name, size in files:
            if not out or held + size > self.task_bytes:
                out.append(Files([]))
                held = 0
            out[-1].names.append(name)
            held += size
        return out

    def rows(self, names: list[str]) -> Iterator[tuple]:
        store, inside = FileSystem.from_uri(self.path)
        for name in names:
            try:
                lines = io.TextIOWrapper(store.open_input_stream(f"{inside}/{name}"), "utf-8", newline="\n")
                for number, line in enumerate(lines):
                    if line.strip():
                        yield from self.items(name, number, line)
            except (OSError, UnicodeDecodeError):
                yield name, None, None, None, None, None, "UNREADABLE"

    def items(self, name: str, number: int, line: str) -> Iterator[tuple]:
        try:
            found = PARSERS[self.kind](line)
        except (ElementTree.ParseError, ValueError, KeyError, TypeError, AttributeError):
            yield name, number, None, None, None, None, "PARSE_ERROR"
            return
        for pos, (title, link, day) in enumerate(found):
            if all(part in (link or "") for part in self.parts):
                yield name, number, pos, title, link, day, None


class FolderReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            match f:
                case EqualTo(attribute=("file",), value=name):
                    self.folder.keep({name})
                case In(attribute=("file",), value=names):
                    self.folder.keep(set(names))
                case StringContains(attribute=("link",), value=part):
                    self.folder.parts.append(part)
                    yield f  # rows with a problem have no link: Spark leaves them out
                case _:
                    yield f

    def partitions(self):
        only = self.folder.file
        return self.folder.dealt([f for f in self.folder.listed() if only is None or f[0] in only]) or [Files([])]

    def read(self, partition: Files):
        return self.folder.rows(partition.names)


class FolderStream(DataSourceStreamReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"after": max((name for name, _ in self.folder.listed()), default="")}

    def partitions(self, start: dict, end: dict):
        return self.folder.dealt([f for f in self.folder.listed() if start["after"] < f[0] <= end["after"]])

    def read(self, partition: Files):
        return self.folder.rows(partition.names)

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


class FolderSource(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return f"attestry_{cls.kind}"

    def schema(self) -> str:
        return COLUMNS

    def folder(self) -> Folder:
        path = self.options["path"]
        return Folder(self.kind, path if "://" in path or path.startswith("file:") else f"file://{path}", int(self.options.get("bytesPerTask", BYTES_PER_TASK)))

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.folder())

    def streamReader(self, schema) -> FolderStream:  # noqa: N802
        return FolderStream(self.folder())


class FeedSource(FolderSource):
    kind = "feed"


class SitemapSource(FolderSource):
    kind = "sitemap"


class ListingSource(FolderSource):
    kind = "listing"


#: The reader of each type of source.
BY_TYPE = {"RSS": FeedSource, "SITEMAP": SitemapSource, "JSON": ListingSource}


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with filters handed to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in BY_TYPE.values():
        spark.dataSource.register(source)
