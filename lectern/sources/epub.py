"""EPUB 2 and 3: package, spine, contents and pages.

The contents give the tree; the documents of the spine give the text. A section of a document joins the entry that
points at it, or becomes one; then everything is put into reading order, and a section stays below an ancestor only if
that is still open there. Resources are named by their path from the archive's root, with a slash before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count
from urllib.parse import unquote_to_bytes

from . import html
from .archive import FONT_TYPES, RESOURCES, Archive, archive_path, check_encryption, decoded, local
from .model import Book, Rejected, Section, Span, at_epub, heading_kind, inline, semantic_kind, stem

DEPTH, ENTRIES = 128, 10_000
MEDIA = {"application/xhtml+xml", "text/html", "image/svg+xml"}
NO_CONTENTS = "the book has no contents; sections come from headings"


@dataclass
class Item:
    id: str
    path: str | None
    media: str
    properties: set[str]
    fallback: str | None


@dataclass
class Entry:
    """A line of the contents or of the page list."""

    label: str
    href: str | None
    id: str | None = None
    kind: str | None = None
    children: list[Entry] = field(default_factory=list)


@dataclass
class Document:
    resource: str
    root: Section
    pages: list[tuple[str, dict]]
    anchors: dict[str, int | None]
    aliases: dict[str, int]


def read_package(archive: Archive) -> tuple[str, object, dict[str, Item]]:
    container = archive.xml("META-INF/container.xml")
    roots = [e.get("full-path") for e in container.iter() if local(e.tag) == "rootfile" and e.get("full-path")]
    if not roots:
        raise Rejected("the container names no package")
    if len(set(roots)) != len(roots):
        raise Rejected("the container names one package twice")
    path = archive_path("", roots[0])
    if path is None:
        raise Rejected("the path of the package leaves the archive")
    package, base = archive.xml(path), path.rpartition("/")[0]
    items: dict[str, Item] = {}
    urls: set[str] = set()
    for e in package.iter():
        if local(e.tag) == "item" and e.get("id"):
            href = e.get("href") or ""
            where = None if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", href) else archive_path(base, href)
            if where is not None and where in urls:
                raise Rejected(f"the manifest has {where} twice")
            urls.add(where or href)
            items[e.get("id")] = Item(e.get("id"), where, e.get("media-type") or "", set((e.get("properties") or "").split()), e.get("fallback"))
            if len(items) > RESOURCES:
                raise Rejected(f"the manifest has over {RESOURCES} resources")
    return base, package, items


def metadata(package, title: str) -> tuple[str, list[str], str | None]:
    """Title, authors (creators with the role of an author or with none) and language."""
    refines: dict[str, list[str]] = {}
    for e in package.iter():
        if local(e.tag) == "meta" and e.get("property") == "role" and (e.get("refines") or "").startswith("#"):
            refines.setdefault(e.get("refines")[1:], []).append((e.text or "").strip().lower())
    found: dict[str, list] = {"title": [], "creator": [], "language": []}
    for e in package.iter():
        if local(e.tag) in found and (e.text or "").strip():
            found[local(e.tag)].append(e)
    authors = []
    for e in found["creator"]:
        roles = [v.lower() for k, v in e.attrib.items() if local(k) == "role"] + refines.get(e.get("id"), [])
        if not roles or "aut" in roles:
            authors.append(e.text.strip())
    first = lambda name: found[name][0].text.strip() if found[name] else None
    return first("title") or title, authors, first("language")


def cover(archive: Archive, package, items: dict[str, Item], warnings: list[str]) -> tuple[str, str, bytes] | None:
    """The image that the manifest or, in older packages, a name in the metadata marks as the cover; a warning if it can't be read."""
    named = next((e.get("content") for e in package.iter() if local(e.tag) == "meta" and e.get("name") == "cover"), None)
    item = next((i for i in items.values() if "cover-image" in i.properties), None) or items.get(named)
    if item is None:
        return None
    try:
        return "/" + item.path, item.media, archive.read(item.path)
    except (Rejected, KeyError, TypeError):
        warnings.append(f"the cover /{item.path or item.id} can't be read; left out")
        return None


def supported(item: Item) -> bool:
    return item.media in MEDIA and "scripted" not in item.properties


def with_fallback(item: Item, items: dict[str, Item]) -> Item | None:
    """The item or the first on its chain of fallbacks that can be read."""
    seen: set[str] = set()
    while item is not None and item.id not in seen:
        if supported(item):
            return item
        seen.add(item.id)
        item = items.get(item.fallback)
    return None


def read_document(archive: Archive, item: Item, warnings: list[str]) -> Document:
    resource = "/" + (item.path or "")
    try:
        source = decoded(archive.read(item.path))
    except (KeyError, UnicodeDecodeError, TypeError) as error:
        raise Rejected(f"{resource} of the spine can't be read: {error}") from None
    nodes, own = html.parse_xhtml(source, f"document {resource}")
    warnings += own
    root = html.document(nodes, html.title_of(nodes) or item.id, resource)
    every = list(html.elements(nodes))
    pages = []
    for e in every:
        if html.has_token(e, "pagebreak"):
            fragment = e.attrs.get("id") if (e.attrs.get("id") or "").strip() else None
            label = (e.attrs.get("title") or e.attrs.get("aria-label") or "").strip() or inline(html.raw_text(e.children))
            if label and (fragment is not None or e.offset is not None):
                pages.append((label, at_epub(resource, fragment, e.offset)))
            else:
                warnings.append(f"a page break in {resource} has no label or no place; left out")
    anchors = {e.attrs["id"]: e.offset for e in every if e.attrs.get("id")}
    return Document(resource, root, pages, anchors, heading_aliases(nodes))


def heading_aliases(nodes: list) -> dict[str, int]:
    """The ids of elements, with the offset of the first heading in each."""
    aliases: dict[str, int] = {}

    def first(siblings: list) -> int | None:
        found = None
        for e in siblings:
            if isinstance(e, html.Element):
                own = e.offset if e.name in html.HEADINGS else first(e.children)
                if own is not None and "id" in e.attrs:
                    aliases[e.attrs["id"]] = own
                found = own if found is None else found
        return found

    first(nodes)
    return aliases


def spoken_label(e: html.Element) -> str:
    """What a reader would say for a link: its label or title, else its text with the texts of its images."""
    named = e.attrs.get("aria-label", e.attrs.get("title"))
    if named is not None and inline(named):
        return inline(named)
    parts, stack = [], list(reversed(e.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            parts.append(node)
        elif node.name == "img":
            parts.append(node.attrs.get("alt", node.attrs.get("title", "")))
        else:
            stack += reversed(node.children)
    return inline(" ".join(parts))


def nav_entries(ol: html.Element, depth: int = 1) -> list[Entry]:
    out = []
    for li in ol.children:
        if isinstance(li, html.Element) and li.name == "li":
            direct = [c for c in li.children if isinstance(c, html.Element)]
            e = next((c for c in direct if c.name == "a"), None) or next((c for c in direct if c.name == "span"), None)
            below = [x for c in direct if c.name == "ol" for x in nav_entries(c, depth + 1)]
            about = e.attrs if e is not None else {}
            out.append(Entry(spoken_label(e) if e is not None else "", about.get("href"), about.get("id", li.attrs.get("id")), about.get("epub:type", about.get("type")), below))
    return out


def read_nav(source: str, resource: str, warnings: list[str]) -> tuple[list[Entry], list[Entry]]:
    nodes, own = html.parse_xhtml(source, f"contents {resource}")
    warnings += own
    contents, pages = [], []
    for e in html.elements(nodes):
        if e.name == "nav":
            kinds = (e.attrs.get("epub:type", e.attrs.get("type")) or "").split()
            lists = [c for c in e.children if isinstance(c, html.Element) and c.name == "ol"]
            if lists and "toc" in kinds:
                contents += nav_entries(lists[0])
            elif lists and "page-list" in kinds:
                pages += nav_entries(lists[0])
    return contents, pages


def read_ncx(root) -> tuple[list[Entry], list[Entry]]:
    def entry(e) -> Entry:
        label = next((inline("".join(t.itertext())) for c in e if local(c.tag) == "navLabel" for t in c if local(t.tag) == "text"), "")
        href = next((c.get("src") for c in e if local(c.tag) == "content"), None)
        return Entry(label, href, e.get("id"), e.get("class"), [entry(c) for c in e if local(c.tag) in ("navPoint", "pageTarget")])

    part = lambda name, child: [entry(c) for e in root if local(e.tag) == name for c in e if local(c.tag) == child]
    return part("navMap", "navPoint"), part("pageList", "pageTarget")


@dataclass
class Row:
    """A line of a tree laid flat: what it holds, the row above it (-1: none) and its depth, from 1."""

    item: Entry | Section
    above: int
    depth: int


def flat(tops: list) -> list[Row]:
    """The rows of trees of anything with ``children``, each before those below it."""
    rows, todo = [], [(x, -1, 1) for x in reversed(tops)]
    while todo:
        item, above, depth = todo.pop()
        rows.append(Row(item, above, depth))
        todo += [(c, len(rows) - 1, depth + 1) for c in reversed(item.children)]
    return rows


class Spine:
    """The documents in reading order, and where the references of the contents and the page list lead."""

    def __init__(self, documents: list[Document]):
        self.order = {d.resource: n for n, d in enumerate(documents)}
        self.anchors = {d.resource: d.anchors for d in documents}

    def target(self, href: str | None, resource: str) -> tuple[Span | None, str | None]:
        """The place that a reference names, and what is wrong with it."""
        if href is None:
            return None, None
        path, _, fragment = href.partition("#")
        path = path.split("?")[0]
        if path:
            path = archive_path("" if path[0] == "/" else resource.lstrip("/").rpartition("/")[0], path.lstrip("/"))
            resource = f"/{path}"
        try:
            fragment = unquote_to_bytes(fragment).decode("utf-8")
        except UnicodeDecodeError:
            pass
        problems = {
            "leads out of the archive": path is None, "leads out of the spine": resource not in self.order,
            f'leads to "{fragment}", which its document lacks': bool(fragment) and fragment not in self.anchors.get(resource, {}),
        }
        for problem, holds in problems.items():
            if holds:
                return None, problem
        where = at_epub(resource, fragment or None, self.anchors[resource].get(fragment) if fragment else None)
        return Span(resource, where, where), None

    def place(self, span: Span | None) -> tuple[int, int] | None:
        """The order of a position: its document's, then its own offset or that of its fragment."""
        if span is None or span.start["resource"] not in self.order:
            return None
        p = span.start
        own = p["character_offset"] if p["character_offset"] is not None else self.anchors[p["resource"]].get(p["fragment"])
        return self.order[p["resource"]], own or 0


def unused(wanted: Iterator[str | None]) -> Iterator[str]:
    """Each id as wanted, if it is not blank and new, else a counted one."""
    used, counted = set(), (f"epub-toc-{n}" for n in count(1))
    for name in wanted:
        if not name or not name.strip() or name in used:
            name = next(x for x in counted if x not in used)
        used.add(name)
        yield name


def contents_rows(entries: list[Entry], resource: str, spine: Spine, warnings: list[str]) -> list[Row]:
    """Rows of sections for the entries that lead somewhere; what stood below others stands in their place."""
    entry_rows = flat(entries)
    kept: dict[int, int] = {-1: -1}  # of each entry, its section's row, or that of the nearest entry above that has one
    rows: list[Row] = []
    for n, row in enumerate(entry_rows):
        label = row.item.label.strip()
        span, problem = spine.target(row.item.href, resource) if label else (None, "has no label")
        above = kept[row.above]
        if problem:
            warnings.append(f'entry "{label}" of the contents {problem}; left out' if label else "an entry of the contents has no label; left out")
            kept[n] = above
            continue
        kept[n] = len(rows)
        depth = rows[above].depth + 1 if above >= 0 else 1
        rows.append(Row(Section(row.item.id, semantic_kind(row.item.kind) or heading_kind(label), label, depth, "Authored", span), above, depth))
    for row, name in zip(rows, unused(r.item.id for r in rows)):
        row.item.id = name
    return rows


class Merged:
    """Rows of the contents and of the documents' sections, with an index over the places that they name.

    A section of a document joins the row that its fragment, else its offset, else the first heading inside an element
    with a row's fragment names; the keys of one lookup, in that order. A key belongs to the first row that has it.
    """

    def __init__(self, rows: list[Row]):
        self.rows, self.index = [], {}
        for row in rows:
            self.add(row.item, row.above, row.depth)

    def add(self, section: Section, above: int, depth: int) -> int:
        n, p = len(self.rows), section.span and section.span.start
        self.rows.append(Row(section, above, depth))
        if p:
            exact = ("fragment", p["resource"], p["fragment"]) if p["fragment"] is not None else ("offset", p["resource"], p["character_offset"])
            for key in (exact, ("document", p["resource"])):
                self.index.setdefault(key, n)
        return n

    def look_up(self, section: Section, aliases: dict[tuple[str, int], int]) -> int | None:
        if section.span is None:
            return None
        p = section.span.start
        exact = ("fragment", p["resource"], p["fragment"]) if p["fragment"] is not None else ("offset", p["resource"], p["character_offset"])
        return self.index.get(exact, aliases.get((p["resource"], p["character_offset"])))

    def named_inside(self, document: Document) -> dict[tuple[str, int], int]:
        """Of the offsets of headings, the first row whose fragment is an element around it."""
        found: dict[tuple[str, int], int] = {}
        for fragment, offset in document.aliases.items():
            n = self.index.get(("fragment", document.resource, fragment))
            key = (document.resource, offset)
            if n is not None and n < found.get(key, n + 1):
                found[key] = n
        return found

    def merge(self, document: Document) -> None:
        first = self.index.get(("document", document.resource))
        names_file = first is not None and self.rows[first].item.span.start["fragment"] is None
        if names_file:
            self.rows[first].item.blocks += document.root.blocks
        else:
            for body in loose(document):
                self.add(body, -1, 1)
        mine, inside = {}, self.named_inside(document)
        for n, row in enumerate(flat(document.root.children)):
            above = mine[row.above] if row.above >= 0 else first
            section, section.children = row.item, []
            met = self.look_up(section, inside)
            if met is None and n == 0 and names_file:
                met = first
            if met is None:
                section.level = self.rows[above].item.level + 1 if above is not None else section.level
                mine[n] = self.add(section, -1 if above is None else above, 0)
                fragment = section.span.start["fragment"] if section.span else None
                if fragment in document.aliases:
                    inside.setdefault((document.resource, document.aliases[fragment]), mine[n])
                continue
            mine[n], own = met, self.rows[met].item
            own.blocks += section.blocks
            if own.kind in ("Section", "Other") and section.kind not in ("Book", "BodyMatter", "Section", "Other"):
                own.kind = section.kind

    def in_reading_order(self, spine: Spine) -> list[Section]:
        """The tree again, sorted by where sections point, else where their text or what is below them begins.

        Rows have intervals of the order that they stood in, so what is below a row is what begins inside its interval.
        Sorted, a row stays open until the first that isn't below it; a row goes below its nearest open one of those
        that it stood below.
        """
        below: dict[int, list[int]] = {}
        for n, row in enumerate(self.rows):
            below.setdefault(row.above, []).append(n)
        order, todo = [], below.get(-1, [])[::-1]
        while todo:
            order.append(todo.pop())
            todo += below.get(order[-1], [])[::-1]
        begin = {n: k for k, n in enumerate(order)}
        end = {n: k + 1 for n, k in begin.items()}
        places: dict[int, tuple[int, int] | None] = {}
        for n in reversed(order):
            row = self.rows[n]
            end[row.above] = max(end.get(row.above, 0), end[n])
            inside = [p for p in map(spine.place, (b.span for b in row.item.blocks)) if p]
            under = [p for p in (places[c] for c in below.get(n, [])) if p]
            places[n] = spine.place(row.item.span) or min(inside or under, default=None)
        last = (len(spine.order) + 1, 0)
        sorted_ = sorted(order, key=lambda n: (places[n] or last, begin[n]))
        at = {n: k for k, n in enumerate(sorted_)}
        is_below = lambda n, a: begin[a] < begin[n] < end[a]
        closed = {a: next((k for k in range(at[a] + 1, len(sorted_)) if not is_below(sorted_[k], a)), len(sorted_)) for a in below if a >= 0}
        tops, depth = [], {-1: 0}
        for n in sorted_:
            a = self.rows[n].above
            while a >= 0 and not at[a] < at[n] < closed[a]:
                a = self.rows[a].above
            depth[n] = depth[a] + 1
            self.rows[n].item.level = depth[n]
            (self.rows[a].item.children if a >= 0 else tops).append(self.rows[n].item)
        return tops


def loose(document: Document) -> list[Section]:
    """The blocks of a document that stand in none of its sections, as a section."""
    where = at_epub(document.resource)
    return [Section(f"epub:{document.resource}:body", "BodyMatter", None, 1, "Derived", Span(document.resource, where, where), document.root.blocks)] if document.root.blocks else []


def marks(entries: list[Entry], resource: str, spine: Spine, warnings: list[str]) -> list[tuple[str, dict, str]]:
    """Pages of a page list in its order; above the bound the whole list is left out."""
    rows, out = flat(entries), []
    if len(rows) > ENTRIES:
        warnings.append(f"the page list has over {ENTRIES} entries; left out")
        return []
    for row in rows:
        label = row.item.label.strip()
        span, problem = spine.target(row.item.href, resource)
        problem = "a page has no label" if not label else f'page "{label}" {problem or "leads nowhere"}' if span is None else None
        if problem:
            warnings.append(f"{problem}; left out")
        else:
            out.append((label, span.start, span.source_id))
    return out


def navigation(archive: Archive, package, items: dict[str, Item], warnings: list[str]) -> tuple[list[Entry], list[Entry], str]:
    """Contents, pages and the resource that has them; what can't be read is a warning."""
    spine = next((e for e in package.iter() if local(e.tag) == "spine"), None)
    nav = next((i for i in items.values() if "nav" in i.properties and i.path), None)
    ncx = items.get(spine.get("toc")) if spine is not None and spine.get("toc") else next((i for i in items.values() if i.media == "application/x-dtbncx+xml"), None)
    for item, is_nav in ((nav, True), (ncx, False)):
        if item is None or item.path is None:
            continue
        try:
            contents, pages = read_nav(decoded(archive.read(item.path)), "/" + item.path, warnings) if is_nav else read_ncx(archive.xml(item.path))
        except (Rejected, KeyError, UnicodeDecodeError) as error:
            warnings.append(f"the contents can't be read ({error})")
            continue
        if contents or pages:
            return contents, pages, "/" + item.path
    return [], [], ""


def import_epub(path: str, content: bytes) -> Book:
    archive = Archive(content)
    _, package, items = read_package(archive)
    check_encryption(archive, {i.path for i in items.values() if i.media in FONT_TYPES and i.path})
    title, authors, language = metadata(package, stem(path))
    warnings: list[str] = []
    documents = []
    for e in package.iter():
        if local(e.tag) != "itemref":
            continue
        primary = items.get(e.get("idref"))
        if primary is None:
            raise Rejected(f'the spine names "{e.get("idref")}", which the manifest lacks')
        used = with_fallback(primary, items)
        if used is None:
            raise Rejected(f"/{primary.path} of the spine is {primary.media}, which can't be read, and so is what stands in for it")
        if used is not primary:
            warnings.append(f"/{used.path} ({used.media}) was read for /{primary.path} ({primary.media})")
        documents.append(read_document(archive, used, warnings))
    contents, page_list, resource = navigation(archive, package, items, warnings)
    spine, entries = Spine(documents), flat(contents)
    too_large = max((r.depth for r in entries), default=0) > DEPTH or len(entries) > ENTRIES
    root = Section("book", "Book", title, 0, "Derived")
    if contents and not too_large:
        merged = Merged(contents_rows(contents, resource, spine, warnings))
        for d in documents:
            merged.merge(d)
        root.children = merged.in_reading_order(spine)
    else:
        warnings.append(f"the contents pass {DEPTH} levels or {ENTRIES} entries; sections come from headings" if too_large else NO_CONTENTS)
        root.children = [s for d in documents for s in (*loose(d), *d.root.children)]
    pages = marks(page_list, resource, spine, warnings) or [(label, where, d.resource) for d in documents for label, where in d.pages]
    version = (package.get("version") or "").strip() or None
    return Book(path, "EPUB", root, title, authors, language, version, pages, warnings, cover(archive, package, items, warnings))
