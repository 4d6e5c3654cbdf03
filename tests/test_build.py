"""What is written beside the sound, checks of it, covers, and walks over linked items."""

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import api, queries_rules
from lectern.operators import build, lookup, prepare
from lectern.operators import synthesis as S
from lectern.sources.epub import import_epub
from lectern.sources.kindle import import_kindle
from lectern.sources.sinks import write_files

from .test_epub import book
from .test_kindle import mobi

PNG = b"\x89PNG\r\n\x1a\nrest"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("shelf")
    (where / "a.md").write_text("# Part I\n\nOne. Two.\n\n## Deep\n\nThree.\n\n### Deeper\n\n# Part II\n\nFour.\n")
    (where / "b.txt").write_text("Only one sentence here.")
    return where


def test_files_are_written_and_read_back(spark, folder, tmp_path):
    library = api.load(spark, str(folder))
    names = {r.book_id: r.title for r in library.books.collect()}
    first = api.preflight(library)
    out = tmp_path / "out"
    saved = {r.name: r.bytes for r in api.save(first, str(out)).collect()}
    assert saved == {r.name: r.bytes for r in api.save(first, str(out)).collect()}  # a task that runs again leaves the same
    assert {str(p.relative_to(out)): p.stat().st_size for p in out.rglob("*") if p.is_file()} == saved
    for book_id in names:
        report = json.loads((out / f"{book_id}.report.json").read_text())
        assert report["complete"] is True and [x["kind"] for x in report["issues"]] == ["source_parse_warning"] * (names[book_id] == "b")
        lines = [json.loads(x) for x in (out / f"{book_id}.prepared.jsonl").read_text().splitlines()]
        assert lines[0]["kind"] == "metadata" and len(lines[0]["source_sha256"]) == 64 and all(x["status"] == "ready" for x in lines[1:])
        assert (out / f"{book_id}.suggestions.txt").read_text().startswith("# ")
    assert api.unusable(library, first.lines).count() == 0
    wrong = api.unusable(library, first.lines, settings=S.Settings(max_characters=300)).collect()
    assert len(wrong) == 2 and {r.reason for r in wrong} == {"it was prepared with other settings"}
    (folder / "b.txt").write_text("Only one sentence there.")
    assert [(names[r.book_id], r.reason) for r in api.unusable(api.load(spark, str(folder)), first.lines).collect()] == [("b", "the source has changed")]

    made = api.convert(library)
    api.save(made, str(out))
    of = {names[b]: b for b in names}
    found = json.loads((out / f"{of['a']}.navigation.json").read_text())
    shape = lambda entries: [(e["title"], e["narrated"], shape(e["children"])) for e in entries]
    assert shape(found["toc"]) == [("Part I", True, [("Deep", True, [("Deeper", True, [])])]), ("Part II", True, [])]
    assert found["toc"][0]["source_range"]["start"] == {"type": "text", "byte_offset": 0} and found["toc"][0]["type"] == "part"
    assert found["pages"] == [] and len(found["sentences"]) == 4 and found["duration_ms"] > 0
    manifest = json.loads((out / f"{of['a']}.manifest.json").read_text())
    assert manifest["source"]["format"] == "Markdown" and len(manifest["source"]["sha256"]) == 64 and manifest["counts"]["narration_units"] == 8 and manifest["metadata"]["cover"] is None
    assert (out / f"{of['b']}.chapters.txt").read_text().startswith(";FFMETADATA1\ntitle=b\n")


def test_unsafe_names_are_refused(spark, tmp_path):
    for name in ("../x", "a/../b", "/x", "", ".", "a\\b"):
        with pytest.raises(Exception, match="not a plain file name"):
            write_files(spark.createDataFrame([(name, "t")], "name string, content string"), str(tmp_path / "w")).collect()
    assert not list(tmp_path.rglob("*"))


def test_covers():
    opf = '<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.png" media-type="image/png"{}/>'
    files = {"a": "<h1>One</h1><p>x</p>"}
    made = import_epub("b.epub", book(files | {"OEBPS/c.png": "pic"}, manifest=opf.format(' properties="cover-image"'), spine='<itemref idref="a"/>'))
    assert made.cover == ("/OEBPS/c.png", "image/png", b"pic")
    assert import_epub("b.epub", book(files | {"OEBPS/c.png": "pic"}, manifest=opf.format(""), spine='<itemref idref="a"/>', meta='<meta name="cover" content="c"/>')).cover[2] == b"pic"
    gone = import_epub("b.epub", book(files, manifest=opf.format(' properties="cover-image"'), spine='<itemref idref="a"/>'))
    assert gone.cover is None and "the cover /OEBPS/c.png can't be read; left out" in gone.warnings
    number = (0).to_bytes(4, "big")
    held = import_kindle("k.mobi", mobi("<h1>K</h1><p>z", meta=[(201, number)], more=[PNG]))
    assert held.cover == ("kindle:record:2", "image/png", PNG) and not any("cover" in w for w in held.warnings)
    assert import_kindle("k.mobi", mobi("<h1>K</h1><p>z", meta=[(201, number)], more=[b"?"])).cover is None


def test_linked_items(spark):
    rows = [("ok", 1, 3, 2, True), ("ok", 2, None, None, False), ("ok", 3, None, 4, False), ("ok", 4, None, None, False), ("round", 1, 2, None, True), ("round", 2, 1, None, False), ("gap", 1, 9, None, True), ("none", 1, None, None, None)]
    got = lookup.linked_walk(spark.createDataFrame(rows, "book_id string, object long, first long, next long, top boolean"))
    by = {b: [(r.object, r.level) if r.problem is None else r.problem for r in got.filter(F.col("book_id") == b).orderBy("item").collect()] for b in ("ok", "round", "gap", "none")}
    assert by == {"ok": [(1, 1), (3, 2), (4, 2), (2, 1)], "round": ["the items form a circle"], "gap": ["an item is missing"], "none": []}
    deep = spark.createDataFrame([("d", n, n + 1 if n < 5 else None, None, n == 0) for n in range(6)], "book_id string, object long, first long, next long, top boolean")
    assert [r.problem for r in lookup.linked_walk(deep, deepest=5).collect()] == ["there are over 5 levels"] and [r.problem for r in lookup.linked_walk(deep, most=5).collect()] == ["there are over 5 items"]


def test_numbers_and_tags(spark):
    values = ["1.2345", " 1", "-0.1", "NaN", "inf", "1e2", "", None, "0.0005", "1e400"]
    got = spark.createDataFrame([(v,) for v in values], "x string").select(build.text_to_ms("x").alias("y")).collect()
    assert [r.y for r in got] == [1235, None, None, None, None, 100000, None, None, 1, None]
    tags = spark.createDataFrame([({"TITLE": "t", "x": "y"},), ({},), (None,)], "m map<string,string>")
    assert [r.y for r in tags.select(build.tag("m", "Title").alias("y")).collect()] == ["t", None, None]


def test_sound_is_written_in_pieces():
    out = io.BytesIO()
    assert S.write_wav(out, [np.array([0.25, -0.5]), 3, np.array([0.125])], buffer=2) == (6, 0.5)
    with wave.open(io.BytesIO(out.getvalue())) as file:
        assert np.frombuffer(file.readframes(9), "<i2").tolist() == [8192, -16384, 0, 0, 0, 4096]
    with pytest.raises(ValueError):
        S.write_wav(io.BytesIO(), [np.array([1.0])])


def test_first_problem_stops_a_book(spark):
    units = lambda *texts: spark.createDataFrame([("b", n, f"u{n}", "s", t) for n, t in enumerate(texts)], "book_id string, unit_ord int, unit_id string, section_id string, text string")
    long = "word " * 200  # 40 words and their blanks are 199 characters
    assert [len(r.phoneme_chunks) for r in prepare.phonemized(units("one two", long)).orderBy("unit_ord").collect()] == [1, 5]
    with pytest.raises(ValueError, match="^u1: "):
        prepare.phonemized(units("fine", "x9y", "z8z"))


@pytest.mark.parametrize("name", ["navigation_documents", "page_cues_by_fragment", "subtree_words", "halved_texts", "epub_blocks"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations", "embeddings"):
        con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    mine = queries_rules.QUERIES[name](spark, sf)
    theirs = con.sql(queries_rules.SQL[name])
    rows = lambda columns, found: sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in found)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(theirs.columns, theirs.fetchall())
