"""Zip archives of books, opened with bounds: nothing is unpacked before names, sizes and encryption are known."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from urllib.parse import unquote_to_bytes

from .model import Rejected

ENTRIES, ENTRY_BYTES, TOTAL_BYTES, MARKUP_DEPTH, RESOURCES = 10_000, 32 << 20, 512 << 20, 128, 10_000
# What may be encrypted, and how: fonts, by the two ways of making them unusable elsewhere.
FONT_TYPES = {"application/font-sfnt", "application/font-woff", "application/vnd.ms-opentype", "font/otf", "font/ttf", "font/woff", "font/woff2"}
FONT_ALGORITHMS = {"http://www.idpf.org/2008/embedding", "http://ns.adobe.com/pdf/enc#RC"}
_MARKUP = re.compile(r"\.(?:xml|opf|ncx|xhtml|html?|svg)$", re.I)


def archive_path(base: str, reference: str) -> str | None:
    """A reference from a folder, decoded and without dots; None if it is empty, absolute, broken or leaves the archive."""
    raw = re.split(r"[?#]", reference, maxsplit=1)[0]
    if re.search(r"%(?![0-9A-Fa-f]{2})", raw):
        return None
    try:
        path = unquote_to_bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not path or path[0] in "/\\" or "\\" in path or ":" in path.split("/")[0]:
        return None
    kept: list[str] = []
    for part in [*base.split("/"), *path.split("/")]:
        if part == "..":
            if not kept:
                return None
            kept.pop()
        elif part not in ("", "."):
            kept.append(part)
    return "/".join(kept) or None


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def decoded(data: bytes) -> str:
    """Markup as text: UTF-16 by its byte order mark, else UTF-8."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    return data.decode("utf-8-sig")


class Archive:
    """Entries of a zip file by name."""

    def __init__(self, content: bytes):
        self._directory(content)
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, NotImplementedError) as error:
            raise Rejected(f"this is no archive: {error}") from None
        infos, total, seen = self.zip.infolist(), 0, set()
        for info in infos:
            name = info.filename
            if name.startswith(("/", "\\")) or "\\" in name or "\0" in name or re.match(r"[A-Za-z]:", name) or ".." in name.split("/"):
                raise Rejected(f"an entry's path leaves the archive: {name!r}")
            if info.flag_bits & 1:
                raise Rejected(f"{name} is encrypted")
            if info.file_size > ENTRY_BYTES:
                raise Rejected(f"{name} is larger than {ENTRY_BYTES} bytes")
            if name.rstrip("/") in seen:
                raise Rejected(f"two entries have the path {name}")
            seen.add(name.rstrip("/"))
            total += info.file_size
            if total > TOTAL_BYTES:
                raise Rejected(f"the entries are larger than {TOTAL_BYTES} bytes in all")
        self.names = {i.filename for i in infos if not i.is_dir()}

    @staticmethod
    def _directory(content: bytes) -> None:
        """The end record's count of entries, before the directory is read."""
        at = content.rfind(b"PK\x05\x06")
        if at < 0 or len(content) < at + 22:
            raise Rejected("this is no archive: it has no directory")
        here, total = struct.unpack_from("<HH", content, at + 8)
        if here != total:
            raise Rejected("the archive has several volumes")
        if total > ENTRIES:
            raise Rejected(f"the archive has over {ENTRIES} entries")

    def read(self, name: str) -> bytes:
        """An entry's bytes. What it declares isn't trusted: reading stops above the bound."""
        if name not in self.names:
            raise KeyError(name)
        try:
            with self.zip.open(name) as file:
                data = file.read(ENTRY_BYTES + 1)
        except (zipfile.BadZipFile, OSError, EOFError, ValueError, NotImplementedError) as error:
            raise Rejected(f"{name} can't be unpacked: {error}") from None
        if len(data) > ENTRY_BYTES:
            raise Rejected(f"{name} is larger than {ENTRY_BYTES} bytes")
        if _MARKUP.search(name) or data.lstrip()[:1] == b"<" or data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            self._depth(name, data)
        return data

    @staticmethod
    def _depth(name: str, data: bytes) -> None:
        depth = 0
        try:
            text = decoded(data)
        except UnicodeDecodeError:
            return
        for m in re.finditer(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[?!][^>]*>|<(/?)([A-Za-z][^\s/>]*)(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(/?)>", text, re.S):
            if m[2] and m[2].lower() not in ("br", "img", "hr", "meta", "link", "input"):
                depth += -1 if m[1] else not m[3]
                if depth > MARKUP_DEPTH:
                    raise Rejected(f"{name} nests deeper than {MARKUP_DEPTH} levels")

    def xml(self, name: str) -> ET.Element:
        try:
            data = self.read(name)
        except KeyError:
            raise Rejected(f"the archive lacks {name}") from None
        if b"<!ENTITY" in data:
            raise Rejected(f"{name} declares entities")
        try:
            return ET.fromstring(decoded(data))
        except (ET.ParseError, UnicodeDecodeError, ValueError) as error:
            raise Rejected(f"{name} is no sound XML: {error}") from None


def check_encryption(archive: Archive, fonts: set[str]) -> None:
    """Only fonts of the package may be encrypted, and only by ways that a reader undoes without a key."""
    if "META-INF/encryption.xml" not in archive.names:
        return
    root = archive.xml("META-INF/encryption.xml")
    for item in (e for e in root.iter() if local(e.tag) == "EncryptedData"):
        method = next((e.get("Algorithm") for e in item.iter() if local(e.tag) == "EncryptionMethod"), None)
        target = next((e.get("URI") for e in item.iter() if local(e.tag) == "CipherReference"), None)
        path = archive_path("", target or "")
        if method not in FONT_ALGORITHMS or path is None or path not in fonts or path not in archive.names:
            raise Rejected("resources other than fonts are locked by DRM")
