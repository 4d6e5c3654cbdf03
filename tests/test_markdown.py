from lectern.sources.markdown import import_markdown


def shape(source):
    book = import_markdown("notes.md", source.encode())
    sections = [(s.title, s.kind, s.level, above[-1] if above else None, s.span and (s.span.start["byte_offset"], s.span.stop["byte_offset"])) for s, above in book.root.walk()]
    blocks = [(s.id, b.kind, b.text, b.span.start["byte_offset"], b.span.stop["byte_offset"]) for s, _ in book.root.walk() for b in s.blocks]
    return sections, blocks


def test_ranges():
    source = "# Part I\n\n## Chapter 1\nMapped prose.\n"
    sections, blocks = shape(source)
    assert sections[1:] == [("Part I", "Part", 1, "book", (0, 8)), ("Chapter 1", "Chapter", 2, "section-1", (10, 22))]
    assert blocks == [("section-2", "Paragraph", "Mapped prose.", 23, len(source) - 1)]


def test_blocks():
    source = "Title\n=====\n\nA *b* __c__ `d*e`\nline  \nnext [link](http://x \"t\") ![pic](u) <b>x</b> &amp; \\* <http://a.b>\n\n> quote\nlazy\n> # in\n\n- one\n- two\n  more\n\n  para\n\n1. x\n2) y\n\n```py\ncode = 1\n```\n\n    indented\n\n***\n\n<div>html\n</div>\n\n[ref]: http://y\n[ref] and [none] snake_case_word"
    sections, blocks = shape(source)
    assert sections[1][:3] == ("Title", "Section", 1)
    assert [b[1:3] for b in blocks] == [
        ("Paragraph", "A b c d*e line next link pic x & * http://a.b"), ("Quote", "quote lazy in"), ("List", "one. two more para"), ("List", "x"), ("List", "y"), ("Code", "code = 1"), ("Code", "indented"), ("Paragraph", "html"),
        ("Paragraph", "ref and [none] snake_case_word"),
    ]
    raw = source.encode()
    assert raw[blocks[1][3] : blocks[1][4]] == b"> quote\nlazy\n> # in" and raw[blocks[5][3] : blocks[5][4]] == b"```py\ncode = 1\n```"


def test_nested_list_and_levels():
    sections, blocks = shape("# a\n### b\n## c\n- x\n  - y\n  - z\n- w\n\ntext\n# d #\n")
    assert [s[:4] for s in sections[1:]] == [("a", "Section", 1, "book"), ("b", "Section", 3, "section-1"), ("c", "Section", 2, "section-1"), ("d", "Section", 1, "book")]
    assert [b[1:3] for b in blocks] == [("List", "x y. z. w"), ("Paragraph", "text")]
    assert shape("") == ([("notes", "Book", 0, None, None)], []) and shape("\n\n***\n")[1] == []
