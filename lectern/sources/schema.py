"""Tables of an imported library. Every table has ``book_id`` and explicit ordinals, as rows have no order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

POSITION = "struct<type:string,byte_offset:bigint,resource:string,fragment:string,character_offset:bigint,page_number:bigint>"
COVER = "struct<source_id:string,media_type:string,content:binary>"
BOOKS = f"book_id string, path string, format string, format_version string, title string, authors array<string>, language string, cover {COVER}, warnings array<string>"
#: ``ancestors`` are the ids from the root down to the parent; ``preorder`` is 0 for the root.
SECTIONS = f"book_id string, section_id string, parent_id string, preorder int, depth int, kind string, title string, level int, provenance string, source_id string, start {POSITION}, stop {POSITION}, ancestors array<string>"
BLOCKS = f"book_id string, section_id string, preorder int, block_ord int, kind string, text string, ordered boolean, items array<string>, alt_text string, caption string, source_id string, start {POSITION}, stop {POSITION}"
PAGES = f"book_id string, page_ord int, label string, position {POSITION}, source_id string"
REJECTS = "book_id string, path string, reason string"


@dataclass
class Library:
    """The tables that an importer makes."""

    books: DataFrame
    sections: DataFrame
    blocks: DataFrame
    pages: DataFrame
    rejects: DataFrame
    #: ``book_id, sha256`` of the files, if they are known
    hashes: DataFrame | None = None
