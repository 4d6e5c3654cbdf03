"""Markdown without extensions: blocks, their byte ranges and plain text.

A block reader over lines, with containers for quotes and list items; inline marks are taken off, so that text reads
as it is spoken. Ranges are bytes of the source, without the line end that closes a block.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

from .html import plain_text
from .model import Block, Book, Outline, Rejected, Section, Span, at_text, heading_kind, source_id, stem, whole

_RULE = re.compile(r" {0,3}([*_-])(?:[ \t]*\1){2,}[ \t]*$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^`]*)$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_HTML = re.compile(r" {0,3}<(?:(script|pre|style|textarea)(?=[\s>]|$)|!--|\?|![A-Za-z]|!\[CDATA\[|/?[A-Za-z][A-Za-z0-9-]*(?=[\s/>]|$))", re.I)
_HTML_BLOCKS = set("address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split())
_REFERENCE = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")


@dataclass
class Line:
    text: str
    start: int
    stop: int


@dataclass
class Node:
    kind: str
    start: int
    stop: int
    text: str = ""
    level: int = 0
    ordered: bool = False
    children: list[Node] = field(default_factory=list)


def source_lines(source: str) -> list[Line]:
    out, at = [], 0
    for piece in re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$", source):
        line = piece.rstrip("\r\n")
        size = len(line.encode())
        out.append(Line(line.expandtabs(4), at, at + size))
        at += len(piece.encode())
    return out


def _indent(text: str) -> int:
    return len(text) - len(text.lstrip(" "))


def _html_end(line: str):
    """How a block of HTML that starts on this line ends: a pattern, or the next empty line; None if it is no such start."""
    m = _HTML.match(line)
    if not m:
        return None
    head = line.lstrip()
    for start, end in (("<!--", "-->"), ("<?", r"\?>"), ("<![CDATA[", r"\]\]>"), ("<!", ">")):
        if head.startswith(start):
            return re.compile(end)
    if m[1]:
        return re.compile(r"</(?:script|pre|style|textarea)>", re.I)
    name = re.match(r"</?([A-Za-z][A-Za-z0-9-]*)", head)[1].lower()
    if name in _HTML_BLOCKS or re.fullmatch(r"<[A-Za-z][^<>]*>\s*|</[A-Za-z][^<>]*>\s*", head):
        return re.compile(r"(?!)")
    return None


def _interrupts(text: str) -> bool:
    item = _ITEM.match(text)
    html_end = _html_end(text)
    return bool(_ATX.match(text) or _RULE.match(text) or _FENCE.match(text) or _QUOTE.match(text) or item and text[item.end() :].strip() and not (item[2][0].isdigit() and item[2][:-1] != "1") or html_end and re.match(r" {0,3}<(?:!|\?|/?(?:%s)[\s/>])" % "|".join([*_HTML_BLOCKS, "script", "pre", "style", "textarea"]), text + " ", re.I))


def blocks(lines: list[Line], references: dict[str, str]) -> list[Node]:
    out: list[Node] = []
    k = 0
    while k < len(lines):
        text = lines[k].text
        if not text.strip():
            k += 1
            continue
        first = k
        if _indent(text) >= 4:
            last = k
            while k < len(lines) and (_indent(lines[k].text) >= 4 or not lines[k].text.strip()):
                last = k if lines[k].text.strip() else last
                k += 1
            out.append(Node("code", lines[first].start, lines[last].stop, "\n".join(x.text[4:] for x in lines[first : last + 1]) + "\n"))
            k = last + 1
            continue
        if fence := _FENCE.match(text):
            k += 1
            body = []
            while k < len(lines) and not re.match(r" {0,3}%s{%d,}[ \t]*$" % (re.escape(fence[2][0]), len(fence[2])), lines[k].text):
                body.append(lines[k].text[min(len(fence[1]), _indent(lines[k].text)) :])
                k += 1
            stop = lines[min(k, len(lines) - 1)].stop
            out.append(Node("code", lines[first].start, stop, "".join(x + "\n" for x in body)))
            k += 1
            continue
        if atx := _ATX.match(text):
            title = "" if atx[2] is None or re.fullmatch(r"#+", atx[2]) else atx[2]
            out.append(Node("heading", lines[k].start, lines[k].stop, title, level=len(atx[1])))
            k += 1
            continue
        if _RULE.match(text):
            k += 1
            continue
        if _QUOTE.match(text):
            inner, lazy = [], False
            while k < len(lines):
                m = _QUOTE.match(lines[k].text)
                if m:
                    inner.append(Line(lines[k].text[m.end() :], lines[k].start, lines[k].stop))
                    lazy = bool(inner[-1].text.strip()) and not _FENCE.match(inner[-1].text)
                elif lazy and lines[k].text.strip() and not _interrupts(lines[k].text):
                    inner.append(lines[k])
                else:
                    break
                k += 1
            out.append(Node("quote", lines[first].start, lines[k - 1].stop, children=blocks(inner, references)))
            continue
        if item := _ITEM.match(text):
            node, k = _list(lines, k, item, references)
            out.append(node)
            continue
        end = _html_end(text)
        if end is not None:
            while k < len(lines):
                if end.pattern == "(?!)" and not lines[k].text.strip():
                    break
                k += 1
                if end.search(lines[k - 1].text):
                    break
            out.append(Node("html", lines[first].start, lines[k - 1].stop, "\n".join(x.text for x in lines[first:k])))
            continue
        body = []
        while k < len(lines) and lines[k].text.strip() and not (body and _interrupts(lines[k].text) and not _SETEXT.match(lines[k].text)):
            rule = _SETEXT.match(lines[k].text)
            if body and rule:
                out.append(Node("heading", lines[first].start, lines[k].stop, "\n".join(body), level=1 if rule[1][0] == "=" else 2))
                body = []
                k += 1
                break
            if not body and (ref := _REFERENCE.match(lines[k].text)):
                references.setdefault(" ".join(ref[1].casefold().split()), ref[2])
                k += 1
                first = k
                continue
            body.append(lines[k].text.strip(" "))
            k += 1
        if body:
            out.append(Node("paragraph", lines[first].start, lines[k - 1].stop, "\n".join(body)))
    return out


def _list(lines: list[Line], k: int, item: re.Match, references: dict[str, str]) -> tuple[Node, int]:
    mark, ordered = item[2][-1], item[2][-1] in ".)"
    node, first = Node("list", lines[k].start, lines[k].stop, ordered=ordered), k
    while k < len(lines):
        m = _ITEM.match(lines[k].text)
        if not m or m[2][-1] != mark or _RULE.match(lines[k].text):
            break
        width = m.end() if lines[k].text[m.end() :].strip() and len(m[0]) - len(m[1]) - len(m[2]) <= 4 else len(m[1]) + len(m[2]) + 1
        inner, start, last = [Line(lines[k].text[width:], lines[k].start, lines[k].stop)], k, k
        k += 1
        while k < len(lines):
            text = lines[k].text
            if not text.strip():
                inner.append(Line("", lines[k].start, lines[k].stop))
            elif _indent(text) >= width:
                inner.append(Line(text[width:], lines[k].start, lines[k].stop))
                last = k
            elif lines[k - 1].text.strip() and not _ITEM.match(text) and not _interrupts(text):
                inner.append(Line(text.lstrip(" "), lines[k].start, lines[k].stop))
                last = k
            else:
                break
            k += 1
        node.children.append(Node("item", lines[start].start, lines[last].stop, children=blocks(inner, references)))
        node.stop = lines[last].stop
    return node, max(k, first + 1)


_INLINE = re.compile(
    r"""(?P<escape>\\[!-/:-@\[-`{-~])|(?P<ticks>`+)|(?P<auto><[A-Za-z][A-Za-z0-9+.-]{1,31}:[^<>\s]*>|<[^<>\s@]+@[^<>\s@]+>)|(?P<tag><(?:/?[A-Za-z][^<>]*|!--.*?--|\?.*?\?|![A-Z][^>]*)>)|(?P<entity>&(?:\#[0-9]{1,7}|\#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)|(?P<break>(?:[ ]{2,}|\\)?\n)|(?P<mark>\*+|_+)|(?P<open>!?\[)|(?P<close>\])""",
    re.S | re.X,
)
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")


def inline_text(text: str, references: dict[str, str]) -> str:
    """A block's words without marks: of links and images the text, of code the code; line ends are blanks."""
    out: list[str] = []
    opened: list[tuple[int, str]] = []
    marks: list[tuple[int, str, bool, bool]] = []
    at = 0
    while at < len(text):
        m = _INLINE.search(text, at)
        if not m:
            out.append(text[at:])
            break
        out.append(text[at : m.start()])
        at = m.end()
        kind, token = m.lastgroup, m[0]
        if kind == "escape":
            out.append(token[1])
        elif kind == "ticks":
            close = re.compile(r"(?<!`)" + token + r"(?!`)").search(text, at)
            if close:
                code = text[at : close.start()].replace("\n", " ")
                out.append(code[1:-1] if code[:1] == code[-1:] == " " and code.strip() else code)
                at = close.end()
            else:
                out.append(token)
        elif kind == "auto":
            out.append(token[1:-1])
        elif kind == "entity":
            out.append(html.unescape(token))
        elif kind == "break":
            if out[-1][-1:] != " ":
                out.append(" ")
        elif kind == "mark":
            before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
            punct = lambda c: bool(re.match(r"[^\w\s]|_", c))
            left = not after.isspace() and (not punct(after) or before.isspace() or punct(before))
            right = not before.isspace() and (not punct(before) or after.isspace() or punct(after))
            can_open = left and (token[0] == "*" or not right or punct(before))
            can_close = right and (token[0] == "*" or not left or punct(after))
            left_over = len(token)
            if can_close:
                while left_over and marks and any(x[1] == token[0] for x in marks):
                    n = max(j for j, x in enumerate(marks) if x[1] == token[0])
                    place = marks[n][0]
                    used = min(left_over, len(out[place]))
                    out[place], left_over = out[place][used:], left_over - used
                    del marks[n + (1 if out[place] else 0) :]
            out.append(token[:left_over])
            if left_over and can_open:
                marks.append((len(out) - 1, token[0], can_open, can_close))
        elif kind == "open":
            opened.append((len(out), token))
            out.append(token)
        elif kind == "close":
            if not opened:
                out.append(token)
                continue
            place, token_open = opened.pop()
            target = _TARGET.match(text, at)
            label = "".join(out[place + 1 :])
            named = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(text, at)
            key = " ".join(((named[1] if named and named[1].strip() else label)).casefold().split())
            if target:
                out[place], at = "", target.end()
            elif key in references:
                out[place], at = "", named.end() if named else at
            else:
                out.append(token)
    return "".join(out)


def _segment(into: str, text: str) -> str:
    return into if not text else into + (" " if into and not into[-1].isspace() else "") + text


def _text(node: Node, references: dict[str, str]) -> str:
    """A block's text, with the text of the blocks in it set apart by blanks."""
    if node.kind in ("heading", "paragraph"):
        return whole(inline_text(node.text, references))
    if node.kind == "code":
        return node.text.strip()
    if node.kind == "html":
        return plain_text(node.text) if node.text.strip() else ""
    if node.kind == "list":
        return ". ".join(t for t in (_text(i, references) for i in node.children) if t)
    out = ""
    for child in node.children:
        out = _segment(out, _text(child, references))
    return whole(out)


def import_markdown(path: str, content: bytes) -> Book:
    try:
        source = content.decode("utf-8")
    except UnicodeDecodeError:
        raise Rejected("the text is not UTF-8") from None
    references: dict[str, str] = {}
    outline, name = Outline(stem(path)), source_id(path)
    for node in blocks(source_lines(source), references):
        text = _text(node, references)
        if not text:
            continue
        span = Span(name, at_text(node.start), at_text(node.stop))
        if node.kind == "heading":
            outline.head(Section(f"section-{outline.next_number()}", heading_kind(text), text, node.level, "Authored", span))
        elif node.kind == "list":
            items = [t for t in (_text(i, references) for i in node.children) if t]
            outline.top().blocks.append(Block("List", text, ordered=node.ordered, items=items, span=span))
        else:
            kind = {"quote": "Quote", "code": "Code"}.get(node.kind, "Paragraph")
            outline.top().blocks.append(Block(kind, text, span=span))
    return Book(path, "Markdown", outline.root, stem(path))
