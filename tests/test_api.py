"""Files of every format through the commands, providers, and the resumable stream."""

import json

import numpy as np
import pytest

from lectern import api
from lectern.operators import synthesis as S
from lectern.streaming.resume import resume, unit_stream

from .test_epub import book
from .test_kindle import mobi


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    files = {"t.txt": b"CHAPTER ONE\nDr. Who came. He left.\n\nCHAPTER TWO\nxyz9 end.", "m.md": b"# Part I\n\nText here.\n\n```\ncode\n```\n", "h.HTML": b"<h1>Top</h1><p>x<p>y", "e.epub": book({"a": "<h1>One</h1><p>Said.</p>"}), "k.mobi": mobi("<h1>K</h1><p>z"), "bad.txt": b"\xff\xfe\xff", "x.doc": b"?", "broken.epub": b"PK"}
    for name, content in files.items():
        (folder / name).write_bytes(content)
    return api.load(spark, str(folder))


def test_formats_and_rejects(library):
    assert sorted((r.format, r.title) for r in library.books.collect()) == [("EPUB", "My Book"), ("HTML", "h"), ("MOBI", "My Book"), ("Markdown", "m"), ("TXT", "t")]
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in library.rejects.collect()} == {"bad.txt": "the text is not UTF-8", "x.doc": "files of type doc are not read", "broken.epub": "this is no archive: it has no directory"}
    lines = [r.line for r in api.inspect(library).orderBy("book_id", "preorder").collect()]
    assert "book|Book|t|blocks:0" in lines and "  section-1|Chapter|Chapter One|blocks:1" in lines


def test_preflight(library):
    found = api.preflight(library)
    report = {r.book_id: r for r in found.report.collect()}
    assert len(report) == 5 and sum(not r.complete for r in report.values()) == 1
    assert [r.token for r in found.suggestions.collect()] == ["xyz9"]
    kinds = sorted(r.kind for r in found.issues.collect())
    assert kinds.count("unknown_g2p_token") == 1 and "excluded_by_policy" in kinds and "source_parse_warning" in kinds
    names = sorted(r.file_name for r in found.chapter_texts.collect())
    assert "002-section-2.txt" in names


def test_convert(library):
    made = api.convert(library)
    books = {r.book_id: r.title for r in library.books.collect()}
    of = {r.book_id: json.loads(r.json) for r in made.navigation.collect()}
    text = next(v for k, v in of.items() if books[k] == "t")
    assert [x["title"] for x in text["toc"]] == ["Chapter One", "Chapter Two"] and text["duration_ms"] > 0 and all(x["narrated"] for x in text["toc"]) and len(text["sentences"]) == 3
    counts = {books[r.book_id]: r for r in made.manifest.collect()}
    assert counts["t"].units == 5 and counts["t"].provider_chunks == counts["t"].generated_chunks + counts["t"].cache_hits
    meta = {books[r.book_id]: r.text for r in made.metadata.collect()}
    assert meta["t"].startswith(";FFMETADATA1\ntitle=t\n[CHAPTER]") and meta["t"].count("[CHAPTER]") == 2
    starts = [r.start_ms for r in made.cues.filter("book_id = '%s'" % next(k for k, v in books.items() if v == "t")).orderBy("place").collect()]
    assert starts == sorted(starts) and api.voices(library.books.sparkSession).count() == 28


def test_settings_and_small_rules(spark):
    for bad in ({"speed": 3}, {"retries": 11}, {"max_phonemes": 511}, {"max_characters": 0}, {"pause_ms": -1}):
        with pytest.raises(ValueError):
            S.Settings(**bad)
    for bad in ("", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            S.output_name(bad)
    cut = lambda x: spark.createDataFrame([(x,)], "x string").select(S.halves("x").alias("y")).first().y
    for text in ("aa bb cc dd", "abcd", "a", " a", "one  two"):
        assert cut(text) == (list(S.split_in_two(text)) if S.split_in_two(text) else None)
    assert cut("aa bb cc dd") == ["aa bb", "cc dd"] and cut("abcd") == ["ab", "cd"] and cut("a") is None
    assert [r.y for r in spark.createDataFrame([("x" * 5,), ("x" * 190,), ("x" * 400,)], "x string").select(S.most_tokens("x").alias("y")).collect()] == [96, 380, 640]
    assert S.to_int16(np.array([0.5 / 32767, -0.5 / 32767, 0.99])).tolist() == [1, -1, 32439] and S.wav_samples(S.wav([np.zeros(3), 4])) == (7, 24_000)
    assert S.wav_samples(b"no") is None and S.wav_samples(S.wav([])) is None and S.generation_seed("a", 1) != S.generation_seed("a", 2)


def test_providers_retry_and_split(spark):
    def flaky():
        seen = []

        def make(text):
            seen.append(text)
            if "!" in text or text == "aa bb cc dd" and len(seen) < 9:
                raise RuntimeError("failed")
            return np.full(len(text), 0.1)

        return make

    asked = spark.createDataFrame([("k1", "aa bb cc dd"), ("k2", "!!!"), ("k3", "fine")], "key string, text string").coalesce(1)
    got = {r.key: r for r in S.synthesized(asked, flaky, split=True).collect()}
    assert got["k1"].samples == 10 and got["k3"].samples == 4 and got["k2"].error == "failed" and S.wav_samples(bytes(got["k1"].content)) == (10, 24_000)


def test_stream_resumes(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    line = lambda **x: json.dumps(x)
    (source / "a.jsonl").write_text("\n".join([line(kind="metadata"), "", line(id="u1", tts_text="one two"), line(unit_id="u2", tts_text="three"), line(id="u3", status="blocked", tts_text="no")]))
    run = lambda: resume(unit_stream(spark, str(source)), store, str(tmp_path / "check")).awaitTermination()
    run()
    first = spark.read.parquet(store).collect()
    assert sorted(r.samples for r in first) == [50, 70]
    (source / "b.jsonl").write_text("\n".join([line(id="u1", tts_text="one two"), line(id="u9", tts_text="new")]))
    run()
    run()
    assert sorted((r.batch, r.samples) for r in spark.read.parquet(store).collect()) == [(0, 50), (0, 70), (1, 30)]
