import struct

import pytest

from lectern.sources import kindle
from lectern.sources.kindle import import_kindle
from lectern.sources.model import Rejected


def exth(*records):
    body = b"".join(struct.pack(">II", k, len(v) + 8) + v for k, v in records)
    return b"EXTH" + struct.pack(">II", 12 + len(body), len(records)) + body


def mobi(text, version=6, compression=1, encoding=65001, meta=(), flags=0, encryption=0, trailer=b"", name=b"My_Book", length=None, more=()):
    data = text if isinstance(text, bytes) else text.encode()
    zero = bytearray(16 + 232)
    struct.pack_into(">HxxIHxxH", zero, 0, compression, len(data) if length is None else length, 1, encryption)
    zero[16:20] = b"MOBI"
    struct.pack_into(">I", zero, 20, 232)
    for at, value in ((28, encoding), (36, version), (84, 0), (88, 0), (108, 2), (128, 0x40 if meta else 0), (168, 0xFFFFFFFF), (240, flags)):
        struct.pack_into(">I", zero, at, value)
    records = [bytes(zero) + (exth(*meta) if meta else b""), data + trailer, *more]
    head = bytearray(78)
    head[: len(name)] = name
    head[60:68] = b"BOOKMOBI"
    struct.pack_into(">H", head, 76, len(records))
    at, table = 78 + 8 * len(records), b""
    for r in records:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(head) + table + b"".join(records)


def test_compression():
    assert kindle.decompress(bytes.fromhex("03616263801 8C1".replace(" ", "")), 100) == b"abcabc A"
    for bad in ("8008", "80", "0561"):
        with pytest.raises(Rejected):
            kindle.decompress(bytes.fromhex(bad), 100)
    with pytest.raises(Rejected):
        kindle.decompress(b"abc", 2)
    assert kindle.without_trailers(b"textab\x83", 2) == b"text" and kindle.without_trailers(b"text\x00", 1) == b"text"


def test_metadata_and_text():
    meta = [(100, b"Ann"), (100, b""), (503, "Títle".encode()), (524, b"en"), (201, struct.pack(">I", 0))]
    book = import_kindle("a.azw3", mobi("<html><body><h1>Chapter One</h1><p>Chapter One</p><p>Téxt.</p></body></html>", 8, meta=meta, more=[b"\xff\xd8\xff0"]))
    assert (book.title, book.authors, book.language, book.format, book.format_version, book.warnings) == ("Títle", ["Ann"], "en", "AZW3", "8", [])
    chapter = book.root.children[0]
    assert [b.text for b in chapter.blocks] == ["Téxt."] and chapter.span.start["byte_offset"] == 16
    assert import_kindle("a.mobi", mobi("<p>x")).title == "My Book"
    assert import_kindle("a.mobi", mobi("<p>caf\xe9".encode("latin-1"), encoding=1252)).root.blocks[0].text == "café"


def test_legacy_contents_become_headings():
    source = '<html><head><guide><reference type="toc" filepos=AAAAAAAAAA /></guide></head><body><p>lead</p><p><b>Chapter One</b></p><p>Text.</p><p>Table of Contents</p><a filepos=BBBBBBBBBB>Chapter One</a></body></html>'
    source = source.replace("AAAAAAAAAA", f"{source.index('<p>Table') + 3:010}").replace("BBBBBBBBBB", f"{source.index('<p><b>Ch') + 3:010}")
    book = import_kindle("a.mobi", mobi(source))
    assert [(s.title, [b.text for b in s.blocks]) for s, _ in book.root.walk()] == [("My Book", ["lead"]), ("Chapter One", ["Text."])]
    assert "made from the links" in book.warnings[0]
    assert "names no table" in import_kindle("a.mobi", mobi("<h1>A</h1><p>x")).warnings[0]


def test_inline_contents_are_cut():
    book = import_kindle("a.azw3", mobi("<html><p>x</p></html><html><div id='calibre_generated_inline_toc'>toc</div></html>", 8))
    assert [b.text for b in book.root.blocks] == ["x"] and "generated table" in book.warnings[0]


@pytest.mark.parametrize(
    "content, what",
    [
        (b"x" * 10, "database header"), (b"x" * 100, "BOOKMOBI"), (mobi("x", encryption=2), "locked"), (mobi("x", compression=17480), "HUFF"), (mobi("x", compression=3), "compression type 3"), (mobi("x", encoding=9), "encoding 9"),
        (mobi(b"\xff"), "UTF-8"), (mobi("x", length=9), "cut off"), (mobi("x", length=0), "no text"), (mobi("x", length=1 << 30), "128 MiB"),
    ],
)
def test_rejects(content, what):
    with pytest.raises(Rejected, match=what):
        import_kindle("a.mobi", content)
