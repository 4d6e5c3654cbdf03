"""Plain text: headings, paragraphs and their byte ranges, without user functions.

Lines are exploded with the length of the line end that follows them; running sums over a book give byte offsets,
the heading above a line and the paragraph that it belongs to. One shuffle, by book.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import source_id, stem, text_heading
from ..functions.text import inline
from .schema import BLOCKS, BOOKS, COVER, PAGES, POSITION, REJECTS, SECTIONS, Library

UNSTRUCTURED = "no headings were found; the text is one body"
_END = r"(?=[\r\n])(?:\r\n?|\n)"


def text_position(offset: Column) -> Column:
    none = F.lit(None)
    return F.struct(F.lit("text").alias("type"), offset.cast("long").alias("byte_offset"), none.cast("string").alias("resource"), none.cast("string").alias("fragment"), none.cast("long").alias("character_offset"), none.cast("long").alias("page_number")).cast(POSITION)


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``book_id, path, line_no, line, start, stop``: lines with byte offsets; the end of the text isn't an empty line."""
    pieces = F.arrays_zip(F.split(text, _END, -1).alias("line"), F.regexp_extract_all(F.col(text), F.lit(_END), F.lit(0)).alias("end"))
    cut = df.select("book_id", "path", F.posexplode(pieces).alias("line_no", "p")).select("book_id", "path", "line_no", F.col("p.line").alias("line"), F.octet_length("p.line").alias("size"), F.coalesce(F.octet_length("p.end"), F.lit(0)).alias("gap"), F.col("p.end").isNull().alias("last"))
    before = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("size") + F.col("gap")).over(before), F.lit(0)).cast("long")
    return cut.withColumn("start", start).withColumn("stop", F.col("start") + F.col("size")).filter(~F.col("last") | (F.col("size") > 0)).drop("last", "gap", "size")


def outlined(df: DataFrame) -> DataFrame:
    """Lines with the collapsed ``norm``, ``heading`` struct, running ``section_no`` and ``part_no``, and ``para_no``."""
    over = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines(df).withColumn("norm", inline("line")).withColumn("heading", text_heading("norm"))
    is_heading = F.col("heading").isNotNull()
    counted = marked.withColumn("section_no", F.sum(is_heading.cast("int")).over(over))
    part = F.max(F.when(F.col("heading.kind") == "Part", F.col("section_no"))).over(over)
    return counted.withColumn("part_no", part).withColumn("para_no", F.sum((is_heading | (F.col("norm") == "")).cast("int")).over(over))


def import_text(df: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, label: df) -> Library:
    """Tables of ``df(book_id, path, text)``; a null text isn't UTF-8 and is rejected.

    All tables come from the outlined lines; ``keep`` may write those, so that they are made once.
    """
    rejects = df.filter("text is null").select("book_id", "path", F.lit("the text is not UTF-8").alias("reason"))
    good = df.filter("text is not null").select("book_id", "path", "text")
    rows = keep(outlined(good).withColumn("source_id", source_id("path")).drop("line", "path"), "lines")
    name = lambda n: F.concat(F.lit("section-"), n.cast("string"))
    # the part that stood above a heading of a chapter; a part's own row names itself
    headed = rows.filter("heading is not null").select(
        "book_id", name(F.col("section_no")).alias("section_id"), F.when((F.col("heading.kind") != "Part") & F.col("part_no").isNotNull(), name(F.col("part_no"))).otherwise(F.lit("book")).alias("parent_id"),
        F.col("section_no").cast("int").alias("preorder"), F.col("heading.kind").alias("kind"), F.col("heading.title").alias("title"), F.lit("Inferred").alias("provenance"), "source_id",
        text_position(F.col("start")).alias("start"), text_position(F.col("stop")).alias("stop"),
    ).withColumn("depth", F.when(F.col("parent_id") == "book", 1).otherwise(2)).withColumn("level", F.col("depth"))
    headed = headed.withColumn("ancestors", F.when(F.col("depth") == 1, F.array(F.lit("book"))).otherwise(F.array(F.lit("book"), F.col("parent_id"))))
    structured = headed.groupBy("book_id").agg(F.count("*").alias("sections"))
    none = F.lit(None)
    known = good.select("book_id", "path").join(structured, "book_id", "left").withColumn("plain", F.col("sections").isNull())
    root = known.select("book_id", F.lit("book").alias("section_id"), none.cast("string").alias("parent_id"), F.lit(0).alias("preorder"), F.lit(0).alias("depth"), F.lit("Book").alias("kind"), stem("path").alias("title"), F.lit(0).alias("level"), F.lit("Derived").alias("provenance"), none.cast("string").alias("source_id"), none.cast(POSITION).alias("start"), none.cast(POSITION).alias("stop"), F.array().cast("array<string>").alias("ancestors"))
    body = known.filter("plain").select("book_id", F.lit("section-1").alias("section_id"), F.lit("book").alias("parent_id"), F.lit(1).alias("preorder"), F.lit(1).alias("depth"), F.lit("BodyMatter").alias("kind"), F.lit("Body").alias("title"), F.lit(1).alias("level"), F.lit("Derived").alias("provenance"), none.cast("string").alias("source_id"), none.cast(POSITION).alias("start"), none.cast(POSITION).alias("stop"), F.array(F.lit("book")).alias("ancestors"))
    order = [c.split()[0] for c in _top_level(SECTIONS)]
    sections = root.unionByName(body).unionByName(headed).select(*order)
    body_lines = rows.filter("heading is null and norm <> ''")
    made = body_lines.groupBy("book_id", "section_no", "para_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "norm"))), lambda x: x["norm"]), " ").alias("text"),
        F.min("start").alias("first"), F.max("stop").alias("final"), F.first("source_id").alias("source_id"), F.min("line_no").alias("at"),
    )
    placed = made.join(known.select("book_id", "plain"), "book_id").withColumn("preorder", F.when(F.col("plain"), 1).otherwise(F.col("section_no")).cast("int"))
    numbered = placed.withColumn("block_ord", F.row_number().over(Window.partitionBy("book_id", "preorder").orderBy("at")))
    blocks = numbered.select(
        "book_id", F.when(F.col("preorder") == 0, "book").otherwise(name(F.col("preorder"))).alias("section_id"), "preorder", "block_ord", F.lit("Paragraph").alias("kind"), "text", none.cast("boolean").alias("ordered"),
        none.cast("array<string>").alias("items"), none.cast("string").alias("alt_text"), none.cast("string").alias("caption"), "source_id", text_position(F.col("first")).alias("start"), text_position(F.col("final")).alias("stop"),
    )
    books = known.select("book_id", "path", F.lit("TXT").alias("format"), none.cast("string").alias("format_version"), stem("path").alias("title"), F.array().cast("array<string>").alias("authors"), none.cast("string").alias("language"), none.cast(COVER).alias("cover"), F.when(F.col("plain"), F.array(F.lit(UNSTRUCTURED))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    spark = df.sparkSession
    return Library(books.select(*[c.split()[0] for c in _top_level(BOOKS)]), sections, blocks.select(*[c.split()[0] for c in _top_level(BLOCKS)]), spark.createDataFrame([], PAGES), rejects.select(*[c.split()[0] for c in _top_level(REJECTS)]))


def _top_level(ddl: str) -> list[str]:
    """The fields of a schema text, without cutting inside angle brackets."""
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]
