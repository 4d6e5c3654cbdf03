"""Small books made of rows, for queries and examples: archives and Kindle files with a heading and paragraphs."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

_XHTML = "application/xhtml+xml"


def epub(title: str, author: str, chapters: list[tuple[str, list[str]]]) -> bytes:
    """An archive with a document a chapter and contents that name each."""
    package, pages = io.StringIO(), {}
    items, order, entries = [], [], []
    for n, (heading, paragraphs) in enumerate(chapters):
        body = f'<h1 id="h">{escape(heading)}</h1>' + "".join(f"<p>{escape(p)}</p>" for p in paragraphs)
        pages[f"c{n}.xhtml"] = f"<html><head><title>{n}</title></head><body>{body}</body></html>"
        items.append(f'<item id="c{n}" href="c{n}.xhtml" media-type="{_XHTML}"/>')
        order.append(f'<itemref idref="c{n}"/>')
        entries.append(f'<li><a href="c{n}.xhtml#h">{escape(heading)}</a></li>')
    pages["nav.xhtml"] = f'<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{"".join(entries)}</ol></nav></body></html>'
    package.write('<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" version="3.0"><metadata>')
    package.write(f"<dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator></metadata><manifest>{''.join(items)}")
    package.write(f'<item id="nav" href="nav.xhtml" media-type="{_XHTML}" properties="nav"/></manifest><spine>{"".join(order)}</spine></package>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="b/p.opf"/></rootfiles></container>')
        archive.writestr("b/p.opf", package.getvalue())
        for name, page in pages.items():
            archive.writestr(f"b/{name}", page)
    return out.getvalue()


def kindle(title: str, author: str, chapters: list[tuple[str, list[str]]]) -> bytes:
    """A Kindle file of one plain record of text, with the title and the author in its metadata."""
    text = "".join(f"<h1>{escape(h)}</h1>" + "".join(f"<p>{escape(p)}</p>" for p in paragraphs) for h, paragraphs in chapters).encode()
    values = [(100, author.encode()), (503, title.encode())]
    body = b"".join(struct.pack(">II", kind, len(v) + 8) + v for kind, v in values)
    zero = bytearray(248)
    struct.pack_into(">HxxIH", zero, 0, 1, len(text), 1)
    zero[16:20] = b"MOBI"
    for place, number in ((20, 232), (28, 65001), (36, 6), (108, 2), (128, 0x40), (168, 0xFFFFFFFF)):
        struct.pack_into(">I", zero, place, number)
    records = [bytes(zero) + b"EXTH" + struct.pack(">II", 12 + len(body), len(values)) + body, text]
    head = bytearray(78)
    head[:6], head[60:68] = b"sample", b"BOOKMOBI"
    struct.pack_into(">H", head, 76, len(records))
    first = 78 + 8 * len(records)
    places = b"".join(struct.pack(">II", first + sum(map(len, records[:k])), 0) for k in range(len(records)))
    return bytes(head) + places + b"".join(records)


MAKERS = {"epub": epub, "mobi": kindle}


def sample_files(rows: DataFrame, ending: str) -> DataFrame:
    """``book_id, path, content, length`` of ``rows(book_id, title, author, heading, paragraphs)``, a file a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(r["book_id"], f"{r['book_id']}.{ending}", MAKERS[ending](r["title"], r["author"], [(r["heading"], r["paragraphs"])])) for r in batch.to_pylist()]
            ids, paths, contents = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(paths, pa.string()), pa.array(contents, pa.binary()), pa.array(map(len, contents), pa.int64())], ["book_id", "path", "content", "length"])

    return rows.select("book_id", "title", "author", "heading", "paragraphs").mapInArrow(run, "book_id string, path string, content binary, length bigint")
