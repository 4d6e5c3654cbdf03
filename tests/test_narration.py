"""Import of text, plans and timelines on small books with times worked out by hand."""

import pytest

from lectern.plans import narration, timeline
from lectern.sources.schema import BLOCKS, BOOKS, PAGES, REJECTS, SECTIONS, Library
from lectern.sources.text import import_text


def position(kind, offset=None, resource=None, fragment=None, character=None, page=None):
    return (kind, offset, resource, fragment, character, page)


def library(spark, sections, blocks, pages=(), title="Book"):
    """Sections as (id, parent, kind, title), blocks as (section, kind, text, offset)."""
    order, above, rows = {}, {}, []
    for k, (sid, parent, kind, name) in enumerate(sections):
        above[sid] = [*above[parent], parent] if parent else []
        order[sid] = k
        rows.append(("b", sid, parent, k, len(above[sid]), kind, name, len(above[sid]), "Authored", None, None, None, above[sid]))
    made, count = [], {}
    for sid, kind, text, offset in blocks:
        count[sid] = count.get(sid, 0) + 1
        where = position("text", offset) if offset is not None else None
        extra = text if kind == "List" else None
        made.append(("b", sid, order[sid], count[sid], kind, None if kind in ("List", "Figure") else text, None, extra, text if kind == "Figure" else None, None, "b.txt", where, where))
    frame = spark.createDataFrame
    return Library(frame([("b", "b.txt", "TXT", None, title, [], None, [])], BOOKS), frame(rows, SECTIONS), frame(made, BLOCKS), frame([("b", k, label, p, "b.txt") for k, (label, p) in enumerate(pages)], PAGES), frame([], REJECTS))


def spans(spark, lib, limit=200, rate=1000, pause=120, **options):
    plan = narration.plan(lib, **options)
    units = timeline.rendered(plan.units, limit, rate, pause).cache()
    return plan, units, [(r.text, r.start_sample * 1000 // rate, r.end_sample * 1000 // rate) for r in units.orderBy("unit_ord").collect()]


def test_two_paragraphs(spark):
    lib = library(spark, [("book", None, "Book", "Book"), ("c1", "book", "Chapter", "Chapter")], [("c1", "Paragraph", "Rain fell. Nobody came.", 0), ("c1", "Paragraph", "Then night", 40)])
    plan, units, got = spans(spark, lib, limit=8, pause=20)
    assert got[0] == ("Chapter", 0, 70) and got[-1][0] == "Then night"
    cues = timeline.timed_cues(plan.cues, units, 1000).orderBy("cue_ord").collect()
    assert [c.kind for c in cues] == ["Sentence", "Sentence", "Paragraph", "Sentence", "Paragraph", "Chapter", "Book"]
    assert cues[-1].start_ms == 0 and cues[-1].end_ms == got[-1][2] == timeline.durations(units, 1000).first().duration_ms


def test_text_import_and_ranges(spark):
    text = "CHAPTER ONE\nFirst paragraph.\n"
    lib = import_text(spark.createDataFrame([("b", "/x/smoke.txt", text)], "book_id string, path string, text string"))
    section = lib.sections.filter("preorder = 1").first()
    assert (section.title, section.kind, section.start.byte_offset, section.stop.byte_offset, section.source_id) == ("Chapter One", "Chapter", 0, 11, "smoke.txt")
    block = lib.blocks.first()
    assert text.encode()[block.start.byte_offset : block.stop.byte_offset].decode() == "First paragraph." == block.text and block.section_id == "section-1"
    assert lib.books.first().title == "smoke" and lib.books.first().warnings == []


def test_text_tree(spark):
    text = "lead\r\nPART I\r\n\r\nCHAPTER ONE\r\né one\r\ntwo\r\n\r\nthree\rCHAPTER TWO\nx\nPART II\nown\nCHAPTER THREE\ny"
    lib = import_text(spark.createDataFrame([("b", "t.txt", text), ("plain", "p.txt", "Chapter one of the tale goes on.\n\nmore"), ("none", "n.txt", None), ("empty", "e.txt", "")], "book_id string, path string, text string"))
    tree = [(r.section_id, r.parent_id, r.title, r.level) for r in lib.sections.filter("book_id = 'b'").orderBy("preorder").collect()]
    assert tree == [("book", None, "t", 0), ("section-1", "book", "Part I", 1), ("section-2", "section-1", "Chapter One", 2), ("section-3", "section-1", "Chapter Two", 2), ("section-4", "book", "Part II", 1), ("section-5", "section-4", "Chapter Three", 2)]
    blocks = lib.blocks.filter("book_id = 'b'").orderBy("preorder", "block_ord").collect()
    assert [(r.section_id, r.text) for r in blocks] == [("book", "lead"), ("section-2", "é one two"), ("section-2", "three"), ("section-3", "x"), ("section-4", "own"), ("section-5", "y")]
    assert all(text.encode()[r.start.byte_offset : r.stop.byte_offset].decode().split() == r.text.split() for r in blocks)
    plain = lib.sections.filter("book_id = 'plain'").orderBy("preorder").collect()
    assert [(r.kind, r.title) for r in plain] == [("Book", "p"), ("BodyMatter", "Body")]
    assert [(r.section_id, r.text) for r in lib.blocks.filter("book_id = 'plain'").orderBy("block_ord").collect()] == [("section-1", "Chapter one of the tale goes on."), ("section-1", "more")]
    assert lib.rejects.first().book_id == "none" and lib.books.filter("book_id = 'empty'").first().warnings
    words = {r.book_id: (r.text, r.words) for r in narration.section_texts(lib.sections, lib.blocks).collect()}
    assert words["plain"] == ("Chapter one of the tale goes on.\n\nmore", 8)


def test_policy(spark):
    sections = [("book", None, "Book", "B"), ("c", "book", "Chapter", "One"), ("n", "book", "Notes", "Notes"), ("n1", "n", "Section", "Inside"), ("k", "book", "Section", "Photo Credits"), ("d", "book", "Chapter", "Two")]
    blocks = [("c", "Paragraph", "12", None), ("c", "List", ["apple", "bee!"], None), ("c", "Figure", "Figure 1 shows", None), ("c", "Figure", "a map", None), ("c", "Footnote", "note.", None), ("c", "Code", "x = 1", None), ("c", "Navigation", "next", None), ("n1", "Paragraph", "gone", None), ("k", "Paragraph", "gone", None), ("d", "Quote", "Said.", None)]
    lib = library(spark, sections, blocks)
    texts = lambda p: [r.text for r in p.units.orderBy("unit_ord").collect()]
    assert texts(narration.plan(lib)) == ["One", "apple.", "bee!", "Figure 1 shows", "Figure.", "a map", "Footnote.", "note.", "Two", "Said."]
    end = narration.plan(lib, "end")
    assert texts(end)[-2:] == ["Footnote.", "note."] and "Two" in texts(end)
    cue = {r.cue_id: r for r in end.cues.collect()}
    assert cue["section:c"].unit_end == texts(end).index("Two") and cue["c:block:5"].kind == "Footnote" and "section:n" not in cue
    skip = [r.warning for r in narration.plan(lib, "skip").warnings.orderBy("warning_ord").collect()]
    assert skip == ["footnote c:block:5 is left out", "code c:block:6 is left out", "list of links c:block:7 is left out", 'notes "Notes" is left out', 'section "Photo Credits" is left out']
    with pytest.raises(ValueError):
        narration.plan(lib, "maybe")


def test_pages_and_chapters(spark):
    sections = [("book", None, "Book", "B"), ("c1", "book", "Chapter", "First"), ("s", "c1", "Section", "Sub"), ("c2", "book", "Chapter", "Second")]
    blocks = [("c1", "Paragraph", "Aaaa.", 10), ("s", "Paragraph", "Bbbb.", 20), ("c2", "Paragraph", "Cccc.", 30)]
    lib = library(spark, sections, blocks, [("1", position("text", 0)), ("2", position("text", 15)), ("9", position("text", 99)), ("p", position("pdf", page=1))])
    plan, units, got = spans(spark, lib)
    pages = {r.label: r.start_ms for r in timeline.page_cues(lib.pages, units, 1000).collect()}
    at = {text: start for text, start, _ in got}
    assert pages == {"1": at["Aaaa."], "2": at["Bbbb."]}
    cues, lengths = timeline.timed_cues(plan.cues, units, 1000), timeline.durations(units, 1000)
    title = lambda policy: [(r.title, r.start_ms, r.end_ms) for r in timeline.chapters(lib.sections, cues, lib.books, lengths, policy).orderBy("chapter_ord").collect()]
    total = got[-1][2]
    assert title("auto") == [("First", 0, at["Second"]), ("Second", at["Second"], total)]
    assert [t for t, _, _ in title("sections")] == ["First", "Sub", "Second"]
    every = timeline.ordered(cues, timeline.page_cues(lib.pages, units, 1000)).orderBy("place").collect()
    assert [c.start_ms for c in every] == sorted(c.start_ms for c in every)
    assert timeline.bad_chapters(timeline.chapters(lib.sections, cues, lib.books, lengths), lengths).count() == 0


def test_pages_by_fragment(spark):
    lib = library(spark, [("book", None, "Book", "B"), ("c", "book", "Chapter", None)], [("c", "Paragraph", "One.", None)], [("i", position("epub", resource="a", fragment="f")), ("ii", position("epub", resource="a", character=5))])
    where = position("epub", resource="a", fragment="f", character=7)
    moved = lib.blocks.drop("start", "stop").crossJoin(spark.createDataFrame([(where, where)], BLOCKS[BLOCKS.index("start") :])).select(*lib.blocks.columns)
    lib.blocks = moved
    _, units, _ = spans(spark, lib)
    assert sorted(r.label for r in timeline.page_cues(lib.pages, units, 1000).collect()) == ["i", "ii"]
