"""What a Python importer builds for one book, and the tables that many books become.

An importer is a function of a path and its bytes. It runs inside an Arrow map, one book at a time, and returns one
row a book with nested lists, which Spark unnests into the library's tables. A book that can't be imported is a row of
rejects, never a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.structure import SEMANTIC_KINDS
from .schema import BLOCKS, BOOKS, PAGES, SECTIONS, Library

#: The blanks of ``functions.text``, for Python, whose own split takes four control characters for blanks.
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")


class Rejected(Exception):
    """The book can't be imported; the message says why."""


def words(text: str) -> list[str]:
    return [w for w in _BLANKS.split(text) if w]


def inline(text: str) -> str:
    return " ".join(words(text))


def whole(text: str) -> str:
    """Blanks collapsed in lines, lines of a paragraph joined, one empty line between paragraphs."""
    lines = [inline(line) for line in re.split(r"\r\n|\r|\n", text)]
    return "\n\n".join(" ".join(p.split("\n")) for p in re.split(r"\n{2,}", "\n".join(lines).strip("\n")) if p)


def at_text(offset: int) -> dict:
    return {"type": "text", "byte_offset": offset}


def at_epub(resource: str, fragment: str | None = None, offset: int | None = None) -> dict:
    return {"type": "epub", "resource": resource, "fragment": fragment, "character_offset": offset}


def at_pdf(page: int, offset: int | None = None) -> dict:
    return {"type": "pdf", "page_number": page, "character_offset": offset}


def at_kindle(offset: int) -> dict:
    return {"type": "kindle", "byte_offset": offset}


@dataclass
class Span:
    source_id: str
    start: dict
    stop: dict


@dataclass
class Block:
    kind: str
    text: str | None = None
    ordered: bool | None = None
    items: list[str] | None = None
    alt_text: str | None = None
    caption: str | None = None
    span: Span | None = None


@dataclass
class Section:
    id: str
    kind: str
    title: str | None
    level: int
    provenance: str
    span: Span | None = None
    blocks: list[Block] = field(default_factory=list)
    children: list[Section] = field(default_factory=list)

    def walk(self, above: tuple[str, ...] = ()) -> Iterator[tuple[Section, tuple[str, ...]]]:
        """Sections before those below them, with the ids above each; without recursion."""
        stack = [(self, above)]
        while stack:
            section, above = stack.pop()
            yield section, above
            stack += [(c, (*above, section.id)) for c in reversed(section.children)]


@dataclass
class Book:
    path: str
    format: str
    root: Section
    title: str | None = None
    authors: list[str] = field(default_factory=list)
    language: str | None = None
    format_version: str | None = None
    pages: list[tuple[str, dict, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    #: source, media type and bytes
    cover: tuple[str, str, bytes] | None = None


def stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] or name


def source_id(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def heading_kind(title: str) -> str:
    first = (words(title) or [""])[0].lower()
    return "Part" if first in ("part", "book") else "Chapter" if first == "chapter" else "Section"


def semantic_kind(tokens: str | None) -> str | None:
    named = {t.removeprefix("doc-") for t in (tokens or "").split()}
    return next((kind for kind, names in SEMANTIC_KINDS if named.intersection(names)), None)


class Outline:
    """Headings by level: a heading closes all open ones of its level or deeper."""

    def __init__(self, title: str):
        self.root, self.open, self.count = Section("book", "Book", title, 0, "Derived"), [], 0

    def head(self, section: Section) -> None:
        while self.open and self.open[-1].level >= section.level:
            self.open.pop()
        self.top().children.append(section)
        self.open.append(section)

    def top(self) -> Section:
        return self.open[-1] if self.open else self.root

    def next_number(self) -> int:
        self.count += 1
        return self.count


def _as_struct(ddl: str) -> str:
    """A table's fields as the inside of a struct type."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return ",".join("{}:{}".format(*f.strip().split(" ", 1)) for f in out)


SCHEMA = f"book_id string, path string, reason string, book struct<{_as_struct(BOOKS)}>, sections array<struct<{_as_struct(SECTIONS)}>>, blocks array<struct<{_as_struct(BLOCKS)}>>, pages array<struct<{_as_struct(PAGES)}>>"


def _ends(span: Span | None) -> dict:
    return {"source_id": span and span.source_id, "start": span and span.start, "stop": span and span.stop}


def nested(book_id: str, book: Book) -> dict:
    """One row of ``SCHEMA``."""
    sections, blocks = [], []
    for n, (s, above) in enumerate(book.root.walk()):
        sections.append({"book_id": book_id, "section_id": s.id, "parent_id": above[-1] if above else None, "preorder": n, "depth": len(above), "kind": s.kind, "title": s.title, "level": min(s.level, 255), "provenance": s.provenance, **_ends(s.span), "ancestors": list(above)})
        for k, b in enumerate(s.blocks):
            blocks.append({"book_id": book_id, "section_id": s.id, "preorder": n, "block_ord": k + 1, "kind": b.kind, "text": b.text, "ordered": b.ordered, "items": b.items, "alt_text": b.alt_text, "caption": b.caption, **_ends(b.span)})
    about = {"book_id": book_id, "path": book.path, "format": book.format, "format_version": book.format_version, "title": book.title, "authors": book.authors, "language": book.language, "cover": book.cover and dict(zip(("source_id", "media_type", "content"), book.cover)), "warnings": book.warnings}
    pages = [{"book_id": book_id, "page_ord": k, "label": label, "position": position, "source_id": source} for k, (label, position, source) in enumerate(book.pages)]
    return {"book_id": book_id, "path": book.path, "reason": None, "book": about, "sections": sections, "blocks": blocks, "pages": pages}


def import_with(df: DataFrame, importer: Callable[[str, bytes], Book]) -> DataFrame:
    """Rows of ``SCHEMA`` for ``df(book_id, path, content)``; a null content is rejected."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for book_id, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if content is None:
                        raise Rejected("the file has no content")
                    row = nested(book_id, importer(path, content))
                except Rejected as error:
                    row = {"book_id": book_id, "path": path, "reason": str(error)}
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return df.select("book_id", "path", "content").mapInArrow(run, schema)


def unnested(rows: DataFrame) -> Library:
    """The library's tables of rows of ``SCHEMA``. Write ``rows`` first: every table reads them."""
    good = rows.filter("reason is null")
    table = lambda name: good.select(F.explode(name).alias("r")).select("r.*")
    return Library(good.select("book.*"), table("sections"), table("blocks"), table("pages"), rows.filter("reason is not null").select("book_id", "path", "reason"))
