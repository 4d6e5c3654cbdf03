"""Lookups along an order, issues and PDF structure."""

from lectern.operators import cache, issues, lookup, prepare
from lectern.sources.pdf import import_pages


def rows(df, *c):
    return [tuple(r) for r in df.select(*c).collect()]


def pdf(spark, pages, outline=(), ranges=(), title=None):
    frame = spark.createDataFrame
    return import_pages(
        frame([("b", "/x/paper.pdf", title, ["Ann"]), ("none", "/x/scan.pdf", None, None)], "book_id string, path string, title string, authors array<string>"), frame([("b", k + 1, t) for k, t in enumerate(pages)] + [("none", 1, " \n")], "book_id string, page int, text string"),
        frame([("b", k, *o) for k, o in enumerate(outline)], "book_id string, item int, title string, level int, page int"), frame([("b", *r) for r in ranges], "book_id string, start_index int, prefix string, style string, start_number int"),
    )


def test_pdf_outline_and_labels(spark):
    lib = pdf(spark, ["One\nfirst  page", "closer\n\n\nsecond", "Two"], [("One", 1, 1), ("Closer", 5, 2), ("Two", 1, 3), ("Past", 1, 9)], [(0, None, "r", None), (1, "A-", "D", 3)])
    assert rows(lib.sections.orderBy("preorder"), "section_id", "parent_id", "title", "level") == [("book", None, "paper", 0), ("pdf-outline-1", "book", "One", 1), ("pdf-outline-2", "pdf-outline-1", "Closer", 2), ("pdf-outline-3", "book", "Two", 1)]
    assert rows(lib.blocks.orderBy("preorder"), "section_id", "text", "start.page_number", "start.character_offset", "stop.character_offset") == [("pdf-outline-1", "first page", 1, 4, 14), ("pdf-outline-2", "second", 2, 7, 15)]
    assert [r[0] for r in rows(lib.pages.orderBy("page_ord"), "label")] == ["i", "A-3", "A-4"] and lib.books.first().warnings == []
    assert rows(lib.rejects, "book_id", "reason") == [("none", "no page has text; pictures of text are not read")]


def test_pdf_inference(spark):
    lib = pdf(spark, ["PART I\nCHAPTER ONE\nalpha\nbeta\n\ngamma", "delta\nCHAPTER TWO\nx"], title=" Named ")
    assert rows(lib.sections.orderBy("preorder"), "section_id", "parent_id", "title", "level") == [("book", None, "Named", 0), ("pdf-inferred-1", "book", "Part I", 1), ("pdf-inferred-2", "pdf-inferred-1", "Chapter One", 2), ("pdf-inferred-3", "pdf-inferred-1", "Chapter Two", 2)]
    assert rows(lib.blocks.orderBy("preorder", "block_ord"), "section_id", "text", "start.page_number", "start.character_offset") == [("pdf-inferred-2", "alpha beta", 1, 19), ("pdf-inferred-2", "gamma", 1, 31), ("pdf-inferred-2", "delta", 2, 0), ("pdf-inferred-3", "x", 2, 18)]
    assert [r[0] for r in rows(lib.pages.orderBy("page_ord"), "label")] == ["1", "2"] and "found in the text: 3" in lib.books.first().warnings[1]
    bare = pdf(spark, ["just text"])
    assert rows(bare.sections.orderBy("preorder"), "section_id") == [("book",), ("pdf-body",)] and rows(bare.blocks, "section_id", "text") == [("pdf-body", "just text")]


def test_as_of_keeps_rows_and_nulls(spark):
    left = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y"), ("a", 5, "y"), ("b", 1, "z")], "k string, at int, v string")
    right = spark.createDataFrame([("a", 2, 1), ("a", 5, 7), ("a", 5, 9)], "k string, at int, w int")
    assert sorted(rows(lookup.as_of(left, right, ["k"], "at", ["w"]), "v", "w"), key=repr) == sorted([("x", None), ("y", 9), ("y", 9), ("z", None)], key=repr)
    assert dict(rows(lookup.as_of(left, right, ["k"], "at", ["w"], descending=True), "v", "w")) == {"x": 1, "y": 9, "z": None}


def test_small_lookups(spark):
    df = spark.createDataFrame([("b", 1, 1, "p"), ("b", 2, 1, "q"), ("b", 2, 2, "q"), ("c", 2, 1, None)], "book_id string, source_rank int, n int, v string")
    assert sorted(rows(lookup.first_source(df), "book_id", "source_rank", "n")) == [("b", 1, 1), ("c", 2, 1)]
    assert rows(lookup.repeated(df, ["book_id", "v"]), "book_id", "v", "n") == [("b", "q", 2)]
    assert sorted(rows(lookup.sole(df, ["book_id"], ["source_rank", "n"]), "book_id", "v"), key=repr) == [("b", "p"), ("c", None)]
    assert rows(lookup.unmatched(df, df.filter("book_id = 'b'"), ["book_id"]), "book_id") == [("c",)]
    other = df.filter("n = 1 and v is not null").withColumn("v", df.v)
    assert sorted(r[0] for r in rows(lookup.zipped_differences(df.filter("book_id = 'b'"), other, ["source_rank", "n"], ["v"]), "n")) == [2]
    runs = spark.createDataFrame([("b", k, v) for k, v in enumerate(["x", "x", None, None, "x"])], "book_id string, at int, v string")
    assert [r[0] for r in rows(lookup.runs(runs, "book_id", "at", "v").orderBy("at"), "run")] == [0, 0, 1, 1, 2]


def test_issues(spark):
    raw = spark.createDataFrame([("b", k, s, kind, f"u{k}", 1) for k, (s, kind) in enumerate([("x", "unknown_g2p_token"), ("y", "excluded_by_policy"), ("x", "unknown_g2p_token")])], "book_id string, issue_ord long, signature string, kind string, unit_id string, occurrences long")
    kept = issues.kept_first(raw)
    assert rows(kept.orderBy("issue_ord"), "signature", "occurrences", "unit_id") == [("x", 2, "u0"), ("y", 1, "u1")]
    assert rows(issues.unresolved(kept), "unresolved") == [(2,)] and sorted(rows(issues.by_kind(kept), "kind", "occurrences")) == [("excluded_by_policy", 1), ("unknown_g2p_token", 2)]


def test_preflight(spark):
    units = spark.createDataFrame([("b", 0, "u0", "s", "Hello wörld. Again!"), ("b", 1, "u1", "s", "the xyz1 end."), ("b", 2, "u2", "t", " "), ("b", 3, "u3", "t", "n̩ ok")], "book_id string, unit_ord long, unit_id string, section_id string, text string")
    lexicon = spark.createDataFrame([("the", "ðə"), ("world", "wɜɹld"), ("n̩", "n̩")], "word string, phonemes string")
    said = spark.createDataFrame([(0, "again", "əɡɛn"), (1, "bad word", "x"), (2, "odd", "€")], "ord int, word string, phonemes string")
    assert sorted(r[0] for r in rows(prepare.bad_pronunciations(said), "ord")) == [1, 2]
    found = prepare.prepare(units, lexicon, said.filter("ord = 0"))
    assert rows(found.units.orderBy("unit_ord"), "unit_id", "status", "phoneme_chunks", "phoneme_repairs") == [("u0", "ready", ["hello wɜɹld. əɡɛn!"], 0), ("u1", "blocked", [], 0), ("u3", "ready", ["ən ok"], 1)]
    assert sorted(rows(found.issues, "signature", "kind", "token"), key=repr) == [("empty_narration_unit:u2", "empty_narration_unit", None), ("unknown_g2p_token:xyz1", "unknown_g2p_token", "xyz1")]
    full = units.withColumn("repairs", __import__("pyspark.sql.functions", fromlist=["x"]).expr("map('dash', cast(2 as bigint))"))
    report = prepare.report(full, found, found.issues).first()
    assert (report.scanned_units, report.scanned_sentences, report.automatic_repairs, report.text_repairs, report.best_effort_pronunciations, report.unresolved, report.complete) == (4, 4, 1, 8, 1, 1, False)
    assert report.issues_by_kind == {"automatic_repair": 1, "empty_narration_unit": 1, "unknown_g2p_token": 1}


def test_cache(spark):
    units = spark.createDataFrame([("b", 0, "same words"), ("b", 1, "same words"), ("b", 2, "other")], "book_id string, unit_ord long, text string")
    asked = cache.requests(units, 100)
    assert [r[0] for r in rows(cache.hits(asked).orderBy("unit_ord"), "hit")] == [False, True, False]
    stored = asked.filter("text = 'other'").select("key")
    assert [r[0] for r in rows(cache.hits(asked, stored).orderBy("unit_ord"), "hit")] == [False, True, True] and rows(cache.missing(asked, stored), "text") == [("same words",)]
    key = asked.first().key
    assert len(key) == 64 and cache.requests(units, 100, cache.Identity(voice="x")).first().key != key
    assert rows(asked.limit(1).select(cache.seed("key").alias("s")), "s")[0][0] == int.from_bytes(bytes.fromhex(key[:8]), "little")


def test_walk_without_bounds(spark, tmp_path):
    """The query walks its whole table, however many levels a book has; the operator keeps the bounds of files."""
    from pyspark.sql import functions as F

    from lectern.operators.lookup import linked_walk
    from lectern.queries_rules import QUERIES

    n = 50 * 1400
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["linked_outlines"](spark, str(tmp_path))
    assert found.filter("book_id <> '0'").agg(F.count("item"), F.max("level"), F.max("item")).first()[:] == (n - 1400, 140, 1399)
    chain = spark.range(200).selectExpr("'b' as book_id", "id as object", "case when id < 199 then id + 1 end as first", "cast(null as long) as next", "id = 0 as top")
    assert [r.problem for r in linked_walk(chain).collect()] == ["there are over 128 levels"]
    assert linked_walk(chain, most=None, deepest=None).count() == 200


def test_pages_without_bounds(spark):
    """A table of more pages than a file may have is read whole where that is asked for, and rejected otherwise."""
    frame = spark.createDataFrame
    books = frame([("b", "b.pdf", None, None)], "book_id string, path string, title string, authors array<string>")
    pages = spark.range(1, 10_002).selectExpr("'b' as book_id", "id as page", "concat('Text ', id) as text")
    outline = frame([("b", 0, "Item", 1, 2)], "book_id string, item int, title string, level int, page int")
    ranges = frame([], "book_id string, start_index int, prefix string, style string, start_number int")
    whole = import_pages(books, pages, outline, ranges, limited=False)
    assert whole.blocks.count() == 10_001 and whole.rejects.count() == 0
    held = import_pages(books, pages, outline, ranges)
    assert held.blocks.count() == 0 and [r.reason for r in held.rejects.collect()] == ["there are over 10000 pages"]
