import io
import zipfile

import pytest

from lectern.sources.epub import import_epub
from lectern.sources.model import Rejected

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'
PAGE = '<html xmlns:epub="http://www.idpf.org/2007/ops"><head><title>t</title></head><body>{}</body></html>'
NAV = '<nav epub:type="toc"><ol>{}</ol></nav>'


def package(manifest, spine, meta="", version="3.0", toc=""):
    return f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:opf="http://www.idpf.org/2007/opf" version="{version}"><metadata><dc:title>My Book</dc:title>{meta}</metadata><manifest>{manifest}</manifest><spine{toc}>{spine}</spine></package>'


def book(files, manifest=None, spine=None, nav=None, **more):
    """An archive of pages by name; the package lists them in order."""
    items = manifest if manifest is not None else "".join(f'<item id="{n}" href="{n}.xhtml" media-type="application/xhtml+xml"/>' for n in files)
    if nav is not None:
        items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("OEBPS/p.opf", package(items, spine if spine is not None else "".join(f'<itemref idref="{n}"/>' for n in files), **more))
        for n, body in files.items():
            z.writestr(f"OEBPS/{n}.xhtml" if "." not in n else n, PAGE.format(body) if "." not in n else body)
        if nav is not None:
            z.writestr("OEBPS/nav.xhtml", PAGE.format(nav))
    return out.getvalue()


def tree(content):
    made = import_epub("x/book.epub", content)
    return made, [(len(above), s.kind, s.title, [b.text for b in s.blocks]) for s, above in made.root.walk()]


def test_contents_and_documents_meet():
    files = {"a": '<h1 id="one">Chapter One</h1><p>first</p><h2>Inner</h2><p>deep</p>', "b": "<p>loose</p><h1>Chapter Two</h1><p>second</p>"}
    nav = NAV.format('<li><a href="a.xhtml#one">One</a></li><li><a href="b.xhtml">Two</a></li>')
    made, got = tree(book(files, nav=nav, meta='<dc:creator id="c">Ann</dc:creator><dc:creator id="d">Ed</dc:creator><meta property="role" refines="#d">edt</meta><dc:language>en</dc:language>'))
    assert got == [(0, "Book", "My Book", []), (1, "Chapter", "One", ["first"]), (2, "Section", "Inner", ["deep"]), (1, "Chapter", "Two", ["loose", "second"])]
    assert made.authors == ["Ann"] and made.language == "en" and made.format_version == "3.0" and made.warnings == []


def test_no_contents():
    made, got = tree(book({"a": "<p>lead</p><h1>Part I</h1>", "b": "<h2>x</h2>"}))
    assert got == [(0, "Book", "My Book", []), (1, "BodyMatter", None, ["lead"]), (1, "Part", "Part I", []), (1, "Section", "x", [])] and "no contents" in made.warnings[0]


def test_broken_entries_move_up_and_ids_are_unique():
    files = {"a": '<h1 id="x">X</h1><h1 id="y">Y</h1>'}
    nav = NAV.format('<li><a href="gone.xhtml">Gone</a><ol><li><a id="i" href="a.xhtml#x">X</a></li><li><a id="i" href="a.xhtml#y">Y</a></li></ol></li><li><a href="a.xhtml#none">N</a></li><li><span></span></li>')
    made, got = tree(book(files, nav=nav))
    assert [(d, t) for d, _, t, _ in got] == [(0, "My Book"), (1, "X"), (1, "Y")] and [s.id for s in made.root.children] == ["i", "epub-toc-1"]
    assert made.warnings == ['entry "Gone" of the contents leads out of the spine; left out', 'entry "N" of the contents leads to "none", which its document lacks; left out', "an entry of the contents has no label; left out"]


def test_reading_order_beats_contents_order():
    files = {"a": '<h1 id="x">X</h1><p>1</p>', "b": '<h1 id="y">Y</h1><p>2</p>'}
    nav = NAV.format('<li><a href="b.xhtml#y">Second</a></li><li><a href="a.xhtml#x">First</a></li>')
    assert [t for _, _, t, _ in tree(book(files, nav=nav))[1]] == ["My Book", "First", "Second"]


def test_pages_and_labels():
    files = {"a": '<h1>H</h1><span id="p1" epub:type="pagebreak" title="1"/><p>x</p><span epub:type="pagebreak"/>'}
    made, _ = tree(book(files))
    assert [(p[0], p[1]["fragment"]) for p in made.pages] == [("1", "p1")] and any("no label or no place" in w for w in made.warnings)
    nav = NAV.format('<li><a href="a.xhtml" title=" Named "><img src="z" alt="pic"/></a></li>') + '<nav epub:type="page-list"><ol><li><a href="a.xhtml#p1">i</a></li><li><a>lost</a></li></ol></nav>'
    made, got = tree(book(files, nav=nav))
    assert [p[0] for p in made.pages] == ["i"] and got[1][2] == "Named"


def test_ncx_and_fallback():
    ncx = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint id="n1"><navLabel><text>Part One</text></navLabel><content src="a.xhtml"/></navPoint></navMap><pageList><pageTarget><navLabel><text>7</text></navLabel><content src="a.xhtml"/></pageTarget></pageList></ncx>'
    manifest = '<item id="f" href="f.pdf" media-type="application/pdf" fallback="a"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    made, got = tree(book({"a": "<p>x</p>", "OEBPS/toc.ncx": ncx, "OEBPS/f.pdf": "%PDF"}, manifest, '<itemref idref="f"/>', version="2.0", toc=' toc="ncx"'))
    assert got[1] == (1, "Part", "Part One", ["x"]) and "/OEBPS/a.xhtml (application/xhtml+xml) was read" in made.warnings[0] and made.pages[0][0] == "7"


def test_utf16_and_recovery():
    out = io.BytesIO(book({"a": "<p>x</p>"}))
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("OEBPS/u.xhtml", PAGE.format("<h1>Ü</h1>").encode("utf-16"))
    assert tree(out.getvalue())[1][1][3] == ["x"]
    made, got = tree(book({"a": "<p>bad<b></p>"}))
    assert "no sound XHTML" in made.warnings[0] and got[1][3] == ["bad"]


@pytest.mark.parametrize(
    "names, what",
    [({"../evil": "x"}, "leaves the archive"), ({"META-INF/encryption.xml": '<e><EncryptedData><EncryptionMethod Algorithm="aes"/><CipherData><CipherReference URI="OEBPS/a.xhtml"/></CipherData></EncryptedData></e>'}, "DRM"), ({"OEBPS/a.xhtml": "again"}, "two entries")],
)
@pytest.mark.filterwarnings("ignore")
def test_unsafe_archives(names, what):
    out = io.BytesIO(book({"a": "<p>x</p>"}))
    with zipfile.ZipFile(out, "a") as z:
        for name, text in names.items():
            z.writestr(name, text)
    with pytest.raises(Rejected, match=what):
        import_epub("a.epub", out.getvalue())


def test_rejects():
    deep = "<div>" * 140 + "x" + "</div>" * 140
    for content, what in ((b"no zip", "archive"), (book({"a": deep}), "nests deeper"), (book({"a": "x"}, spine='<itemref idref="zz"/>'), "manifest lacks"), (book({"a": "x"}, manifest='<item id="a" href="a.xhtml" media-type="text/plain"/>'), "stands in")):
        with pytest.raises(Rejected, match=what):
            import_epub("a.epub", content)
