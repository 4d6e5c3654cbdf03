"""From sections and blocks to spoken units and cues.

A unit is a sentence; its ordinal follows the reading order: a section's heading, its blocks, the sections below it.
A section that is left out takes all below it along. Cues keep the order in which a walk would meet their ends:
sentences, then their block, then the sections that end there, innermost first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import cue_kind, is_skipped, kind_label
from ..functions.text import ascii_lower, exploded, is_page_number, sentences, terminated, trim, with_speech
from ..sources.schema import Library

FOOTNOTES = ("inline", "skip", "end")
#: Larger than any ordinal.
LAST = 2**31 - 1


@dataclass
class Plan:
    """``units``, ``cues`` (with the units from ``unit_start`` up to before ``unit_end``) and ``warnings``."""

    units: DataFrame
    cues: DataFrame
    warnings: DataFrame


def pruned(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections that are read, and the topmost of those that aren't."""
    skipped = sections.filter(is_skipped("kind", "title")).select("book_id", F.col("section_id").alias("above"))
    inside = sections.select("book_id", "section_id", F.explode("ancestors").alias("above")).join(skipped, ["book_id", "above"]).select("book_id", "section_id").distinct()
    itself = skipped.withColumnRenamed("above", "section_id")
    kept = sections.join(inside.unionByName(itself), ["book_id", "section_id"], "left_anti")
    tops = sections.join(itself, ["book_id", "section_id"], "left_semi").join(inside, ["book_id", "section_id"], "left_anti")
    return kept, tops


def spoken_blocks(blocks: DataFrame, footnotes: str = "inline") -> DataFrame:
    """``blocks`` with what each says aloud (null: nothing), its cue, whether it waits for the end, and a warning."""
    if footnotes not in FOOTNOTES:
        raise ValueError(f"footnotes must be one of {', '.join(FOOTNOTES)}")
    k, text = F.col("kind"), F.coalesce("text", F.lit(""))
    figure = F.coalesce("caption", "alt_text", F.lit(""))
    told = F.when(ascii_lower(F.regexp_replace(figure, r"^[\s]+", "")).startswith("figure"), figure).otherwise(F.concat(F.lit("Figure. "), figure))
    said = (
        F.when(k.isin("Paragraph", "Quote", "Aside"), F.when(~is_page_number(text), text)).when(k == "List", F.array_join(F.transform(F.coalesce("items", F.array().cast("array<string>")), terminated), " "))
        .when(k == "Figure", F.when(trim(figure) != "", told)).when((k == "Footnote") & (footnotes != "skip"), F.concat(F.lit("Footnote. "), text))
    )
    block_id = F.concat_ws(":", "section_id", F.lit("block"), F.col("block_ord").cast("string"))
    warning = (
        F.when((k == "Footnote") & (footnotes == "skip"), F.concat(F.lit("footnote "), block_id, F.lit(" is left out")))
        .when(k == "Navigation", F.concat(F.lit("list of links "), block_id, F.lit(" is left out"))).when(k == "Code", F.concat(F.lit("code "), block_id, F.lit(" is left out")))
    )
    cue = F.when(k.isin("Figure", "Footnote"), k).otherwise("Paragraph")
    return blocks.select("*", block_id.alias("item_id"), said.alias("said"), cue.alias("cue"), ((k == "Footnote") & (footnotes == "end")).alias("deferred"), warning.alias("warning"))


def plan(library: Library, footnotes: str = "inline", keep: Callable[[DataFrame, str], DataFrame] = lambda df, label: df, originals: bool = True, parts: int | None = None) -> Plan:
    """``keep`` may write the units, which the cues read too, and cut the lineage there.

    A unit's original text is that of its whole item. Only the first sentence carries it until it is asked for, so that
    what moves and is written grows with the text and not with the square of a paragraph. Without ``originals`` the
    units lack that column. Where the blocks are dealt by book into ``parts``, headings are too, and the blocks stay in place.
    """
    kept, tops = pruned(library.sections)
    told = spoken_blocks(library.blocks, footnotes).join(kept.select("book_id", "section_id"), ["book_id", "section_id"], "left_semi")
    headings = kept.filter(~F.col("kind").isin("Book", "BodyMatter") & F.col("title").isNotNull()).select(
        "book_id", "section_id", "preorder", F.lit(0).alias("block_ord"), F.concat(F.col("section_id"), F.lit(":heading")).alias("item_id"), F.col("title").alias("said"), F.lit(None).cast("string").alias("cue"), F.lit(False).alias("deferred"), "source_id", "start", "stop"
    )
    headings = headings.repartition(parts, "book_id") if parts else headings
    items = headings.unionByName(told.filter("said is not null").select(*headings.columns))
    spoken = with_speech(items, "said")
    split = exploded(spoken, ["*"], sentences("spoken"), "sentence_no", "text")  # none of a unit with nothing to say
    order = Window.partitionBy("book_id").orderBy("deferred", "preorder", "block_ord", "sentence_no")
    empty = F.create_map().cast("map<string,bigint>")
    is_first = F.col("sentence_no") == 0
    made = split.select(
        "book_id", F.concat_ws(":", "item_id", F.lit("sentence"), (F.col("sentence_no") + 1).cast("string")).alias("unit_id"), "section_id", *([F.when(is_first, F.col("said")).alias("said")] if originals else []), "text",
        "source_id", "start", "stop", F.when(is_first, F.col("repairs")).otherwise(empty).alias("repairs"), "item_id", "cue", "deferred", "preorder", "block_ord", "sentence_no",
    )
    kept_units = keep(made.withColumn("unit_ord", F.row_number().over(order) - 1), "units")
    whole = [F.max("said").over(Window.partitionBy("book_id", "item_id")).alias("original_text")] if originals else []
    units = kept_units.select("book_id", "unit_ord", "unit_id", "section_id", *whole, "text", "source_id", "start", "stop", "repairs", "item_id", "cue", "deferred", "preorder", "block_ord", "sentence_no")
    skipped = tops.select("book_id", "preorder", F.lit(0).alias("at"), F.concat(kind_label("kind"), F.lit(' "'), F.coalesce("title", F.lit("Untitled")), F.lit('" is left out')).alias("warning"))
    warned = told.filter("warning is not null").select("book_id", "preorder", F.col("block_ord").alias("at"), "warning")
    warnings = skipped.unionByName(warned).select("book_id", (F.row_number().over(Window.partitionBy("book_id").orderBy("preorder", "at")) - 1).alias("warning_ord"), "warning")
    return Plan(units, cues(kept_units, kept), warnings)


def section_spans(units: DataFrame, sections: DataFrame) -> DataFrame:
    """Units of each section and all below it, without those that wait for the end; sections without any are absent."""
    own = units.filter("not deferred").groupBy("book_id", "section_id").agg(F.min("unit_ord").alias("low"), F.max("unit_ord").alias("high"))
    each = sections.select("book_id", "section_id", F.explode(F.array_append("ancestors", F.col("section_id"))).alias("above"), F.col("preorder").alias("within"))
    met = each.join(own, ["book_id", "section_id"], "left").groupBy("book_id", F.col("above").alias("section_id")).agg(F.min("low").alias("unit_start"), (F.max("high") + 1).alias("unit_end"), F.max("within").alias("last"))
    return met.filter("unit_start is not null")


#: The order of the walk, and what cues carry along.
WALK, BASE = ["deferred_key", "k1", "k2", "k3", "k4"], ["source_id", "start", "stop", "section_id"]


def cues(units: DataFrame, sections: DataFrame) -> DataFrame:
    """Sentence, block and section cues with the ordinal of the walk."""
    key, base = WALK, BASE
    deferred = F.col("deferred").cast("int")
    own = units.filter("cue is not null")
    sentence = own.select("book_id", F.col("unit_id").alias("cue_id"), F.lit("Sentence").alias("kind"), F.col("unit_ord").alias("unit_start"), (F.col("unit_ord") + 1).alias("unit_end"), *base, deferred.alias(key[0]), F.col("preorder").alias(key[1]), F.lit(0).alias(key[2]), F.col("block_ord").alias(key[3]), F.col("sentence_no").alias(key[4]))
    block = own.groupBy("book_id", "item_id", "cue", "section_id", "deferred", "preorder", "block_ord").agg(F.min("unit_ord").alias("unit_start"), (F.max("unit_ord") + 1).alias("unit_end"), F.first("source_id").alias("source_id"), F.first("start").alias("start"), F.first("stop").alias("stop"))
    block = block.select("book_id", F.col("item_id").alias("cue_id"), F.col("cue").alias("kind"), "unit_start", "unit_end", *base, deferred.alias(key[0]), F.col("preorder").alias(key[1]), F.lit(0).alias(key[2]), F.col("block_ord").alias(key[3]), F.lit(LAST).alias(key[4]))
    every = sentence.unionByName(block).unionByName(_section_cues(units, sections))
    return _walked(every)


def section_cues(units: DataFrame, sections: DataFrame) -> DataFrame:
    """The section cues alone, in the order that they have among all; needs no texts or positions of ``units``."""
    return _walked(_section_cues(units, sections))


def _section_cues(units: DataFrame, sections: DataFrame) -> DataFrame:
    section = section_spans(units, sections).join(sections.select("book_id", "section_id", "preorder", F.col("kind").alias("own_kind"), "source_id", "start", "stop"), ["book_id", "section_id"])
    return section.select("book_id", F.concat(F.lit("section:"), F.col("section_id")).alias("cue_id"), cue_kind("own_kind").alias("kind"), "unit_start", "unit_end", *BASE, F.lit(0).alias(WALK[0]), F.col("last").alias(WALK[1]), F.lit(1).alias(WALK[2]), (-F.col("preorder")).alias(WALK[3]), F.lit(0).alias(WALK[4]))


def _walked(every: DataFrame) -> DataFrame:
    return every.withColumn("cue_ord", F.row_number().over(Window.partitionBy("book_id").orderBy(*WALK)) - 1).drop(*WALK)


def section_texts(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """``book_id, text, words``: titles and blocks of each book in reading order, an empty line between them."""
    from ..functions.text import word_count

    shown = F.when(F.col("kind") == "Figure", F.coalesce("caption", "alt_text", F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    titles = sections.filter(~F.col("kind").isin("Book", "BodyMatter") & F.col("title").isNotNull()).select("book_id", "preorder", F.lit(0).alias("at"), F.col("title").alias("part"))
    parts: DataFrame = titles.unionByName(blocks.select("book_id", "preorder", F.col("block_ord").alias("at"), shown.alias("part")))
    joined: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("preorder", "at", "part"))), lambda x: x["part"]), "\n\n")
    return parts.groupBy("book_id").agg(joined.alias("text")).withColumn("words", word_count("text"))


def subtree_words(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """``book_id, section_id, own_words, words``: words of a section's blocks, and with those of all sections below it. Titles don't count."""
    from ..functions.text import word_count

    shown = F.when(F.col("kind") == "Figure", F.coalesce("caption", "alt_text", F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    own = blocks.groupBy("book_id", "section_id").agg(F.sum(word_count(shown)).cast("long").alias("n"))
    each = sections.join(own, ["book_id", "section_id"], "left").select("book_id", "section_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.explode(F.array_append("ancestors", F.col("section_id"))).alias("above"))
    mine = F.when(F.col("above") == F.col("section_id"), F.col("n")).otherwise(0)
    return each.groupBy("book_id", F.col("above").alias("section_id")).agg(F.sum(mine).cast("long").alias("own_words"), F.sum("n").cast("long").alias("words"))
