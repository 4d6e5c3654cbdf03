"""PDF from text that was extracted a page at a time: outlines, inferred headings and page labels as DataFrames.

No reader of PDF files is part of this library. What a reader gives, one row a page, is enough for the structure: a
page belongs to the deepest last item of the outline that begins on it or before it, or, without an outline, headings
are found in the lines. Positions are pages and characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import heading_kind, source_id, stem, text_heading
from ..functions.text import ascii_lower, inline, trim
from ..operators.lookup import clamped_levels, outline_of_pages, page_labels, parents
from .schema import COVER, POSITION, Library

PAGES, PAGE_BYTES, TOTAL_BYTES = 10_000, 16 << 20, 128 << 20
NO_TEXT = "no page has text; pictures of text are not read"
NO_LABELS = "the pages have no labels; they are numbered as they come"
NO_HEADINGS = "neither an outline nor headings were found; the text is one body"
NOT_TAGGED = "structure comes from the text alone, tags are not read"


def at_page(page: Column, offset: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit("pdf").alias("type"), none.cast("long").alias("byte_offset"), none.cast("string").alias("resource"), none.cast("string").alias("fragment"), offset.cast("long").alias("character_offset"), page.cast("long").alias("page_number")).cast(POSITION)


def page_text(c: str) -> Column:
    """A page's lines with collapsed blanks, without empty ones at either end."""
    lines = F.transform(F.split(c, r"\r\n|\r|\n"), inline)
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+\z", "")


def bounded(books: DataFrame, pages: DataFrame, limited: bool = True) -> tuple[DataFrame, DataFrame]:
    """Pages of the books that keep the bounds (if ``limited``) and have text, and the others with a reason."""
    made = pages.select("book_id", F.col("page").cast("long").alias("page"), page_text(F.coalesce("text", F.lit(""))).alias("text"), F.octet_length(F.coalesce("text", F.lit(""))).alias("raw"))
    sums = made.groupBy("book_id").agg(F.count("*").alias("n"), F.max("raw").alias("largest"), F.sum(F.octet_length("text")).alias("total"), F.max(trim("text") != "").alias("some"))
    known = books.select("book_id", "path").join(sums, "book_id", "left")
    reason = F.when(F.col("n").isNull() | ~F.col("some"), NO_TEXT)
    if limited:
        reason = (
            reason.when(F.col("n") > PAGES, f"there are over {PAGES} pages").when(F.col("largest") > PAGE_BYTES, f"a page has over {PAGE_BYTES >> 20} MiB of text")
            .when(F.col("total") > TOTAL_BYTES, f"the pages have over {TOTAL_BYTES >> 20} MiB of text")
        )
    judged = known.withColumn("reason", reason)
    return made.drop("raw").join(judged.filter("reason is null").select("book_id"), "book_id", "left_semi"), judged.filter("reason is not null").select("book_id", "path", "reason")


def _section(rows: DataFrame) -> DataFrame:
    return rows.select("book_id", "section_id", "parent_id", "preorder", "depth", "kind", "title", F.col("depth").alias("level"), "provenance", "source_id", "start", "stop", "ancestors")


def from_outline(pages: DataFrame, outline: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and blocks of books with ``outline(book_id, item, title, level, page)``, items counted from 0."""
    name = lambda n: F.concat(F.lit("pdf-outline-"), (n + 1).cast("string"))
    clamped = clamped_levels(outline, at="item").withColumnRenamed("level", "depth_level")
    tree = parents(clamped, at="item", level="depth_level")
    known = outline.drop("level").join(tree, ["book_id", "item"]).join(names, "book_id")
    where = at_page(F.col("page"), F.lit(0))
    sections = _section(known.select(
        "book_id", name(F.col("item")).alias("section_id"), F.coalesce(name(F.col("parent")), F.lit("book")).alias("parent_id"), (F.col("item") + 1).cast("int").alias("preorder"), (F.size("above") + 1).alias("depth"), heading_kind("title").alias("kind"), "title",
        F.lit("Authored").alias("provenance"), "source_id", where.alias("start"), where.alias("stop"), F.concat(F.array(F.lit("book")), F.transform("above", name)).alias("ancestors"),
    ))
    mine = pages.join(outline.select("book_id").distinct(), "book_id", "left_semi")
    placed = outline_of_pages(mine, outline).join(outline.select("book_id", "item", "title"), ["book_id", "item"], "left")
    first = F.substring_index("text", "\n", 1)
    same = F.coalesce(ascii_lower(inline(first)) == ascii_lower(inline("title")), F.lit(False))
    rest = F.regexp_replace(F.substring("text", F.char_length(first) + 1, F.char_length("text")), r"^\n+", "")
    start = F.when(same & F.contains("text", F.lit("\n")), F.char_length(first) + 1).when(same, F.char_length(first)).otherwise(0)
    kept = placed.withColumn("body", F.when(same, rest).otherwise(F.col("text"))).withColumn("first", start).filter(trim("body") != "")
    numbered = kept.withColumn("preorder", F.coalesce(F.col("item") + 1, F.lit(0)).cast("int")).withColumn("block_ord", F.row_number().over(Window.partitionBy("book_id", "preorder").orderBy("page")))
    blocks = numbered.join(names, "book_id").select("book_id", F.when(F.col("item").isNull(), "book").otherwise(name(F.col("item"))).alias("section_id"), "preorder", "block_ord", F.col("body").alias("text"), "source_id", at_page(F.col("page"), F.col("first")).alias("start"), at_page(F.col("page"), F.char_length("text")).alias("stop"))
    return sections, blocks


def inferred(pages: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sections, blocks and the number of headings of books without an outline. Paragraphs end with their page."""
    cut = pages.select("book_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = Window.partitionBy("book_id", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("first", F.coalesce(F.sum(F.char_length("line") + 1).over(before), F.lit(0))).withColumn("last", F.col("first") + F.char_length("line")).withColumn("heading", text_heading("line"))
    over = Window.partitionBy("book_id").orderBy("page", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("heading").isNotNull()
    counted = placed.withColumn("section_no", F.sum(is_heading.cast("int")).over(over))
    counted = counted.withColumn("part_no", F.max(F.when(F.col("heading.kind") == "Part", F.col("section_no"))).over(over)).withColumn("para_no", F.sum((is_heading | (F.col("line") == "")).cast("int")).over(over))
    name = lambda n: F.concat(F.lit("pdf-inferred-"), n.cast("string"))
    under = (F.col("heading.kind") != "Part") & F.col("part_no").isNotNull()
    headed = counted.filter("heading is not null").join(names, "book_id")
    found = headed.groupBy("book_id").agg(F.count("*").alias("headings"))
    sections = headed.select(
        "book_id", name(F.col("section_no")).alias("section_id"), F.when(under, name(F.col("part_no"))).otherwise("book").alias("parent_id"), F.col("section_no").cast("int").alias("preorder"), F.when(under, 2).otherwise(1).alias("depth"), F.col("heading.kind").alias("kind"), F.col("heading.title").alias("title"),
        F.lit("Inferred").alias("provenance"), "source_id", at_page(F.col("page"), F.col("first")).alias("start"), at_page(F.col("page"), F.col("last")).alias("stop"), F.when(under, F.array(F.lit("book"), name(F.col("part_no")))).otherwise(F.array(F.lit("book"))).alias("ancestors"),
    )
    none = F.lit(None)
    bare = pages.select("book_id").distinct().join(found, "book_id", "left_anti")
    body = bare.select("book_id", F.lit("pdf-body").alias("section_id"), F.lit("book").alias("parent_id"), F.lit(1).alias("preorder"), F.lit(1).alias("depth"), F.lit("BodyMatter").alias("kind"), F.lit("Body").alias("title"), F.lit("Derived").alias("provenance"), none.cast("string").alias("source_id"), none.cast(POSITION).alias("start"), none.cast(POSITION).alias("stop"), F.array(F.lit("book")).alias("ancestors"))
    made = counted.filter("heading is null and line <> ''").groupBy("book_id", "section_no", "page", "para_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("text"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    owned = made.join(bare.withColumn("bare", F.lit(True)), "book_id", "left").join(names, "book_id").withColumn("preorder", F.when(F.col("bare"), 1).otherwise(F.col("section_no")).cast("int"))
    numbered = owned.withColumn("block_ord", F.row_number().over(Window.partitionBy("book_id", "preorder").orderBy("page", "first")))
    section = F.when(F.col("bare"), "pdf-body").when(F.col("preorder") == 0, "book").otherwise(name(F.col("preorder")))
    blocks = numbered.select("book_id", section.alias("section_id"), "preorder", "block_ord", "text", "source_id", at_page(F.col("page"), F.col("first")).alias("start"), at_page(F.col("page"), F.col("last")).alias("stop"))
    return _section(sections.unionByName(body)), blocks, found


def import_pages(books: DataFrame, pages: DataFrame, outline: DataFrame, label_ranges: DataFrame, limited: bool = True) -> Library:
    """The library of ``books(book_id, path, title, authors)`` from ``pages(book_id, page, text)``, pages counted from 1.

    ``outline(book_id, item, title, level, page)`` and ``label_ranges(book_id, start_index, prefix, style,
    start_number)`` may lack a book. Outline items past the last page are left out. The bounds are those of files; a table
    that isn't read from files can do without them (``limited``).
    """
    good, rejects = bounded(books, pages, limited)
    known = books.join(good.select("book_id").distinct(), "book_id", "left_semi").withColumn("source_id", source_id("path")).withColumn("title", F.coalesce(F.when(trim("title") != "", trim("title")), stem("path")))
    names = known.select("book_id", "source_id")
    last = good.groupBy("book_id").agg(F.max("page").alias("last_page"))
    real = outline.join(last, "book_id").filter("page between 1 and last_page and title is not null").drop("last_page")
    items = real.withColumn("item", (F.row_number().over(Window.partitionBy("book_id").orderBy("item")) - 1).cast("long")).withColumn("page", F.col("page").cast("long"))
    authored, own = from_outline(good, items, names)
    guessed, other, found = inferred(good.join(items.select("book_id").distinct(), "book_id", "left_anti"), names)
    none = F.lit(None)
    root = known.select("book_id", F.lit("book").alias("section_id"), none.cast("string").alias("parent_id"), F.lit(0).alias("preorder"), F.lit(0).alias("depth"), F.lit("Book").alias("kind"), "title", F.lit(0).alias("level"), F.lit("Derived").alias("provenance"), none.cast("string").alias("source_id"), none.cast(POSITION).alias("start"), none.cast(POSITION).alias("stop"), F.array().cast("array<string>").alias("ancestors"))
    blocks = own.unionByName(other).select("book_id", "section_id", "preorder", "block_ord", F.lit("Paragraph").alias("kind"), "text", none.cast("boolean").alias("ordered"), none.cast("array<string>").alias("items"), none.cast("string").alias("alt_text"), none.cast("string").alias("caption"), "source_id", "start", "stop")
    marks = page_labels(good.select("book_id", (F.col("page") - 1).alias("page_index")), label_ranges).join(names, "book_id")
    marked = marks.select("book_id", F.col("page_index").cast("int").alias("page_ord"), "label", at_page(F.col("page_index") + 1, F.lit(0)).alias("position"), "source_id")
    about = known.join(items.select("book_id").distinct().withColumn("outlined", F.lit(True)), "book_id", "left").join(found, "book_id", "left").join(label_ranges.select("book_id").distinct().withColumn("labelled", F.lit(True)), "book_id", "left")
    said = F.array_compact(F.array(
        F.when(F.col("labelled").isNull(), NO_LABELS), F.when(F.col("outlined").isNull(), F.coalesce(F.concat(F.lit("there is no outline; headings found in the text: "), F.col("headings").cast("string"), F.lit("")), F.lit(NO_HEADINGS))), F.when(F.col("outlined").isNull(), NOT_TAGGED),
    ))
    listed = about.select("book_id", "path", F.lit("PDF").alias("format"), none.cast("string").alias("format_version"), "title", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), none.cast("string").alias("language"), none.cast(COVER).alias("cover"), said.alias("warnings"))
    return Library(listed, root.unionByName(authored).unionByName(guessed), blocks, marked, rejects)
