"""When each unit, cue, page and chapter starts and ends.

Speech is not synthesised here: a provider is an expression for the samples of a piece of text. The default gives ten
samples for each character, which makes times exact and testable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import HIDDEN_KINDS, MAJOR_KINDS
from ..functions.text import pieces, trim

RATE, PAUSE_MS, LIMIT = 24_000, 120, 400
Provider = Callable[[Column], Column]


def mock_samples(text: Column) -> Column:
    return F.greatest(F.char_length(text) * 10, F.lit(1)).cast("long")


def to_ms(samples: str, rate: int = RATE) -> Column:
    """Whole milliseconds of a column of samples, rounded down."""
    return F.expr(f"{samples} * 1000 div {rate}")


def rendered(units: DataFrame, limit: int = LIMIT, rate: int = RATE, pause_ms: int = PAUSE_MS, provider: Provider = mock_samples) -> DataFrame:
    """``units`` with ``requests``, ``samples``, ``start_sample``, ``end_sample`` and the ``silence`` after each but the last."""
    pause = rate * pause_ms // 1000
    counted = units.withColumn("pieces", pieces("text", limit)).withColumn("requests", F.size("pieces")).withColumn("samples", F.aggregate(F.transform("pieces", provider), F.lit(0).cast("long"), lambda a, x: a + x)).drop("pieces")
    order = Window.partitionBy("book_id").orderBy("unit_ord")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("samples") + pause).over(before), F.lit(0)).cast("long")
    return (
        counted.withColumn("start_sample", start).withColumn("end_sample", F.col("start_sample") + F.col("samples"))
        .withColumn("silence", F.when(F.lead("unit_ord").over(order).isNotNull(), F.lit(pause)).otherwise(F.lit(0)))
    )


def durations(units: DataFrame, rate: int = RATE) -> DataFrame:
    """``book_id, duration_ms`` of books with units."""
    return units.groupBy("book_id").agg(F.max("end_sample").alias("end_sample")).select("book_id", to_ms("end_sample", rate).alias("duration_ms"))


def timed_cues(cues: DataFrame, units: DataFrame, rate: int = RATE) -> DataFrame:
    """Cues with times: the start of their first unit, the end of their last."""
    begin = units.select("book_id", F.col("unit_ord").alias("unit_start"), "start_sample")
    final = units.select("book_id", (F.col("unit_ord") + 1).alias("unit_end"), "end_sample")
    met = cues.filter("unit_end > unit_start").join(begin, ["book_id", "unit_start"]).join(final, ["book_id", "unit_end"])
    return met.withColumn("start_ms", to_ms("start_sample", rate)).withColumn("end_ms", to_ms("end_sample", rate)).drop("start_sample", "end_sample")


def comparable(position: str) -> Column:
    """What two positions must share to be compared, as one key; epub positions need the resource."""
    p = lambda f: F.col(f"{position}.{f}")
    return F.when(p("type") == "epub", F.concat(F.lit("epub:"), p("resource"))).otherwise(p("type"))


def place(position: str) -> Column:
    """The order of positions that share a key: pages then characters, or offsets; null for an epub position without one."""
    p = lambda f: F.col(f"{position}.{f}")
    none = F.lit(0).cast("long")
    return (
        F.when(p("type") == "pdf", F.struct(p("page_number").alias("a"), F.coalesce(p("character_offset"), none).alias("b")))
        .when((p("type") == "epub") & p("character_offset").isNotNull(), F.struct(none.alias("a"), p("character_offset").alias("b")))
        .when(p("type").isin("text", "kindle"), F.struct(none.alias("a"), p("byte_offset").alias("b")))
    )


def page_cues(pages: DataFrame, units: DataFrame, rate: int = RATE) -> DataFrame:
    """Each page starts with the first unit, in unit order, that isn't before it.

    A forward as-of lookup by ordinal: pages and units meet in one window a key, units by descending place, and the
    least ordinal so far is the answer. No range join, and nothing is paired. Epub pages and units without offsets meet
    on equal fragments instead.
    """
    keyed = units.select("book_id", comparable("start").alias("key"), place("start").alias("place"), "unit_ord").filter("key is not null and place is not null")
    asked = pages.select("book_id", "page_ord", comparable("position").alias("key"), place("position").alias("place")).filter("key is not null and place is not null")
    both = keyed.withColumn("page_ord", F.lit(None).cast("int")).unionByName(asked.withColumn("unit_ord", F.lit(None).cast("int")))
    # units at the page's own place come before it
    later = Window.partitionBy("book_id", "key").orderBy(F.desc("place"), F.col("page_ord").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    by_place = both.withColumn("first", F.min("unit_ord").over(later)).filter("page_ord is not null").select("book_id", "page_ord", "first")
    fragment = lambda df, p: df.filter(f"{p}.type = 'epub' and {p}.fragment is not null").select("book_id", F.col(f"{p}.resource").alias("resource"), F.col(f"{p}.fragment").alias("fragment"), F.col(f"{p}.character_offset").alias(f"offset_{p}"), *(["unit_ord"] if p == "start" else ["page_ord"]))
    same = fragment(pages, "position").join(fragment(units, "start"), ["book_id", "resource", "fragment"]).filter("offset_position is null or offset_start is null").groupBy("book_id", "page_ord").agg(F.min("unit_ord").alias("first"))
    found = by_place.unionByName(same).groupBy("book_id", "page_ord").agg(F.min("first").alias("unit_ord")).filter("unit_ord is not null")
    named = found.join(pages, ["book_id", "page_ord"]).join(units.select("book_id", "unit_ord", "start_sample", "section_id"), ["book_id", "unit_ord"])
    return named.select("book_id", "page_ord", F.concat_ws(":", F.lit("page"), "label", (F.col("page_ord") + 1).cast("string")).alias("cue_id"), "label", to_ms("start_sample", rate).alias("start_ms"), "section_id", "source_id", "position")


def ordered(cues: DataFrame, pages: DataFrame) -> DataFrame:
    """All cues by start; those that start together keep the walk's order, pages last."""
    count = Window.partitionBy("book_id")
    own = cues.select("book_id", "cue_id", "kind", F.lit(None).cast("string").alias("label"), "start_ms", "end_ms", "section_id", F.lit(0).alias("late"), "cue_ord")
    paged = pages.select("book_id", "cue_id", F.lit("Page").alias("kind"), "label", "start_ms", F.lit(None).cast("long").alias("end_ms"), "section_id", F.lit(1).alias("late"), F.col("page_ord").alias("cue_ord"))
    return own.unionByName(paged).withColumn("place", F.row_number().over(count.orderBy("start_ms", "late", "cue_ord")) - 1).drop("late", "cue_ord")


def chapters(sections: DataFrame, cues: DataFrame, books: DataFrame, lengths: DataFrame, policy: str = "auto") -> DataFrame:
    """``chapter_ord, section_id, title, start_ms, end_ms`` of each book: a chapter lasts until the next.

    ``auto`` takes major sections where a book has any, else all visible ones. Of sections that start together the
    first cue wins; a book without any becomes one chapter with its title.
    """
    if policy not in ("auto", "chapters", "sections"):
        raise ValueError("policy must be auto, chapters or sections")
    major, visible = F.col("kind").isin(MAJOR_KINDS), ~F.col("kind").isin(HIDDEN_KINDS)
    some = F.max(major.cast("int")).over(Window.partitionBy("book_id")) == 1
    wanted = {"auto": F.when(some, major).otherwise(visible), "chapters": major, "sections": visible}[policy]
    shown = sections.select("book_id", "section_id", trim("title").alias("title"), wanted.alias("wanted")).filter("wanted and title is not null and title <> ''")
    mine = cues.filter("cue_id like 'section:%' and section_id is not null").select("book_id", "section_id", "start_ms", "cue_ord")
    first = mine.withColumn("n", F.row_number().over(Window.partitionBy("book_id", "section_id").orderBy("start_ms", "cue_ord"))).filter("n = 1")
    apart = first.join(shown, ["book_id", "section_id"]).withColumn("n", F.row_number().over(Window.partitionBy("book_id", "start_ms").orderBy("cue_ord"))).filter("n = 1")
    chosen = apart.select("book_id", "section_id", "title", "start_ms")
    bare = books.join(lengths.filter("duration_ms > 0"), "book_id", "left_semi").join(chosen, "book_id", "left_anti")
    whole = bare.select("book_id", F.lit("book").alias("section_id"), F.coalesce("title", F.lit("Audiobook")).alias("title"), F.lit(0).cast("long").alias("start_ms"))
    order = Window.partitionBy("book_id").orderBy("start_ms")
    every = chosen.unionByName(whole).join(lengths, "book_id")
    end = F.greatest(F.coalesce(F.lead("start_ms").over(order), F.col("duration_ms")), F.col("start_ms") + 1)
    return every.select("book_id", (F.row_number().over(order) - 1).alias("chapter_ord"), "section_id", "title", "start_ms", end.alias("end_ms"))


def bad_chapters(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """Chapters that end before they start, go back, or pass the end by over a second."""
    order = Window.partitionBy("book_id").orderBy("chapter_ord")
    checked = found.withColumn("before", F.lag("start_ms").over(order)).join(lengths, "book_id")
    return checked.filter("end_ms <= start_ms or start_ms < before or end_ms > duration_ms + 1000").drop("before", "duration_ms")
