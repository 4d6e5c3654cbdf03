"""Queries over the test tables, one or more for each operator, and the same questions for a SQL engine.

The tables hold few of the signs that the text rules act on, so ``DECORATED`` adds them to every document by its id,
with one expression for both engines. The SQL is written from the rules, not from the Spark expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import phonemes as P
from .functions import structure as S
from .functions import text as T
from .operators import cache, issues, lookup, prepare
from .plans import narration, sidecar, timeline
from .sources.text import import_text, text_position
from .storage import dealt, in_buckets, spread, written

DECORATED = (
    "concat(case doc_id % 7 when 0 then 'PART I\nCHAPTER ONE\n' when 1 then 'Chapter 1: Start\n\n' when 2 then 'chapter one explains\n' else '' end, text, "
    "'\n\nSee https://www.x.com/a-b [', cast(doc_id % 30 as string), ']. “It cost $', cast(doc_id as string), ',000,” said Dr. Ames—twice… hy-\nphen ra\u200bdio co\u00adop "
    "5 × 3 = 15 © a\u00a0b . . . Done (http://e.org/q?x#y).\n', case doc_id % 3 when 0 then '\nCHAPTER TWO\nMore words here.\n\n12\n' else '' end)"
)
RATE, LIMIT, PIECE, PACK = 24_000, 400, 200, 160
Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", F.expr(DECORATED).alias("text"))


def dealt_library(spark: SparkSession, sf_dir: str):
    """All documents as books. Each moves once, to the others of its bucket; the lines, which every table reads, are written once. With the number of buckets."""
    rows, parts = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("doc_id").cast("string").alias("book_id")), "book_id")
    named = rows.select("book_id", "doc_id", F.expr(DECORATED).alias("text")).select("book_id", F.concat(F.lit("d"), "book_id", F.lit(".txt")).alias("path"), "text")
    return import_text(named, keep=partial(in_buckets, parts=parts)), parts


def library(spark: SparkSession, sf_dir: str):
    return dealt_library(spark, sf_dir)[0]


def planned(spark: SparkSession, sf_dir: str, once: bool = False, columns: tuple[str, ...] = ()):
    """The library, its plan and the rendered units, without original texts. Tables that several steps read are written once.

    Queries that read the units ``once`` and no cues have them as they are made, without the columns that they don't ask for;
    with ``columns``, these alone are written.
    """
    lib, parts = dealt_library(spark, sf_dir)
    lib.sections = written(lib.sections, "sections")
    plan = narration.plan(lib, **{} if once or columns else {"keep": partial(in_buckets, parts=parts)}, originals=False, parts=parts)
    if columns:
        plan.units = in_buckets(plan.units.select(*columns), "units", parts)
    return lib, plan, timeline.rendered(plan.units, LIMIT, RATE)


def doc_id():
    return F.col("book_id").cast("long").alias("doc_id")


def speech_normalize(spark, sf_dir):
    return T.with_speech(documents(spark, sf_dir)).select("doc_id", "spoken")


def repair_counts_by_rule(spark, sf_dir):
    each = T.with_speech(documents(spark, sf_dir)).select(F.explode_outer("repairs").alias("rule", "n")).filter("rule is not null")
    return each.groupBy("rule").agg(F.sum("n").alias("repairs"), F.count("*").alias("documents"))


def sentence_split(spark, sf_dir):
    return T.exploded(T.with_speech(documents(spark, sf_dir)), ["doc_id"], T.sentences("spoken"), "sentence_no", "sentence")


def conversation_sentences(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").transform(lambda df: T.exploded(df, ["conv_id", "turn"], T.sentences("text"), "sentence_no", "sentence"))


def greedy_chunks(spark, sf_dir):
    return T.exploded(documents(spark, sf_dir), ["doc_id"], T.chunks("text", PIECE), "chunk_no", "chunk")


def pack_sentences(spark, sf_dir):
    spoken = T.with_speech(documents(spark, sf_dir)).select("doc_id", T.sentences("spoken").alias("s"))
    return T.exploded(spoken, ["doc_id"], T.packed_sentences("s", PACK), "chunk_no", "chunk")


def whole_text_paragraphs(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", T.paragraphs("text").alias("text"))


def ascii_fold(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", T.ascii_fold("text").alias("folded"))


def txt_sections(spark, sf_dir):
    return library(spark, sf_dir).sections.select(doc_id(), "section_id", "parent_id", "preorder", "level", "kind", "title", F.col("start.byte_offset").alias("start_byte"), F.col("stop.byte_offset").alias("stop_byte"))


def txt_blocks(spark, sf_dir):
    return library(spark, sf_dir).blocks.select(doc_id(), "section_id", "block_ord", "text", F.col("start.byte_offset").alias("start_byte"), F.col("stop.byte_offset").alias("stop_byte"))


def section_word_counts(spark, sf_dir):
    lib = library(spark, sf_dir)
    return narration.section_texts(lib.sections, lib.blocks).select(doc_id(), F.col("words").cast("long").alias("words"), F.char_length("text").cast("long").alias("characters"))


def narration_units(spark, sf_dir):
    return planned(spark, sf_dir, once=True)[1].units.select(doc_id(), F.col("unit_ord").cast("long").alias("unit_ord"), "unit_id", "text")


def unit_timeline(spark, sf_dir):
    units = planned(spark, sf_dir, once=True)[2]
    return units.select(doc_id(), F.col("unit_ord").cast("long").alias("unit_ord"), F.col("requests").cast("long").alias("requests"), timeline.to_ms("start_sample", RATE).alias("start_ms"), timeline.to_ms("end_sample", RATE).alias("end_ms"), F.col("silence").cast("long").alias("silence"))


def cue_intervals(spark, sf_dir):
    _, plan, units = planned(spark, sf_dir)
    return timeline.timed_cues(plan.cues, units, RATE).select(doc_id(), "cue_id", "kind", "start_ms", "end_ms")


def narration_totals(spark, sf_dir):
    """How long each document is when read aloud, with its units and requests."""
    units = planned(spark, sf_dir, once=True)[2]
    return units.groupBy("book_id").agg(F.count("*").alias("units"), F.sum("requests").cast("long").alias("requests"), F.max("end_sample").alias("end_sample")).select(doc_id(), "units", "requests", timeline.to_ms("end_sample", RATE).alias("duration_ms"))


def page_cues_forward_asof(spark, sf_dir):
    lib, _, units = planned(spark, sf_dir, columns=("book_id", "unit_ord", "section_id", "text", "start"))
    size = F.octet_length("text")
    marks = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("book_id"), F.explode(F.sequence(F.lit(0), (size / 1000).cast("int"))).alias("page_ord"))
    pages = marks.select("book_id", "page_ord", (F.col("page_ord") + 1).cast("string").alias("label"), text_position(F.col("page_ord") * 1000).alias("position"), F.lit("x").alias("source_id"))
    return timeline.page_cues(pages, units, RATE).select(doc_id(), F.col("page_ord").cast("long").alias("page_ord"), "cue_id", "start_ms", "section_id")


def visible_chapters(spark, sf_dir):
    lib, _, units = planned(spark, sf_dir, once=True)
    units = written(units.select("book_id", "unit_ord", "section_id", "deferred", "start_sample", "end_sample"), "rendered")
    cues = narration.section_cues(units, narration.pruned(lib.sections)[0])
    found = timeline.chapters(lib.sections, timeline.timed_cues(cues, units, RATE), lib.books, timeline.durations(units, RATE))
    return found.select(doc_id(), F.col("chapter_ord").cast("long").alias("chapter_ord"), "section_id", "title", "start_ms", "end_ms")


def chapter_islands(spark, sf_dir):
    units = planned(spark, sf_dir, once=True)[1].units
    return lookup.chapter_texts(units).select(doc_id(), F.col("chapter").cast("long").alias("chapter"), "file_name", F.sha2("text", 256).alias("text_sha256"))


def cache_hits(spark, sf_dir):
    asked = cache.hits(cache.requests(planned(spark, sf_dir, once=True)[1].units, LIMIT))
    return asked.groupBy("book_id").agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("long")).alias("hits")).select(doc_id(), "requests", "hits")


def manifest_counts(spark, sf_dir):
    lib, plan, _ = planned(spark, sf_dir, columns=("book_id", "unit_ord", "text"))
    found = sidecar.counts(narration.section_texts(lib.sections, lib.blocks), plan.units, cache.hits(cache.requests(plan.units, LIMIT)))
    return found.select(doc_id(), *[F.col(c).cast("long").alias(c) for c in ("source_words", "source_characters", "narrated_words", "units", "narrated_characters", "provider_chunks", "cache_hits", "generated_chunks")])


def page_labels_backward_asof(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 5).cast("string").alias("book_id"), F.floor(F.col("doc_id") / 5).alias("page_index"))
    ranges = spark.sql("select cast(b as string) book_id, i start_index, p prefix, s style, n start_number from values (0, 0, '', 'r', 1), (0, 9, 'A-', 'D', 3), (1, 4, 'x', 'a', 1), (2, 0, 'p', null, 1), (2, 7, '', 'R', 40), (3, 0, '', 'A', 20) as t(b, i, p, s, n)")
    return lookup.page_labels(pages, ranges)


def outline_assignment(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 5).alias("book_id"), F.floor(F.col("doc_id") / 5).alias("page"))
    outline = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") % 5).alias("book_id"), F.floor(F.col("page_id") / 10).alias("page"), (F.col("page_id") % 3 + 1).alias("level"), F.col("page_id").alias("item"))
    return lookup.outline_of_pages(pages, outline)


def clamped_levels(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 50).alias("book_id"), F.floor(F.col("doc_id") / 50).alias("item"), (F.col("n_chars") % 7).alias("level"))
    return lookup.clamped_levels(rows).withColumn("level", F.col("level").cast("long"))


def section_parents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 50).alias("book_id"), F.floor(F.col("doc_id") / 50).alias("preorder"), (F.col("n_chars") % 5).alias("level"))
    return lookup.parents(rows).drop("above")


def prepared(spark, sf_dir, once: bool = False):
    """The plan and its prepared units. Queries that read the issues ``once`` have them from units and sentences that aren't written."""
    plan = planned(spark, sf_dir, **{"once": True} if once else {"columns": ("book_id", "unit_ord", "unit_id", "text", "repairs")})[1]
    lexicon = spark.sql("select * from values ('the', 'ðə'), ('Ames', 'Amz'), ('5', 'fIv'), ('3', 'θɹi'), ('15', 'fɪftin') as t(word, phonemes)")
    units = plan.units.withColumn("text", F.regexp_replace("text", "[^\\p{L}\\p{N}'.,;:!?() ]", " "))
    return plan, prepare.prepare(units, lexicon, hold=None if once else written)


def issue_dedup_keep_first(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") % 20).cast("string").alias("book_id"), F.floor(F.col("doc_id") / 20).alias("issue_ord"), F.concat(F.col("source"), F.lit(":"), F.md5(F.col("text").cast("binary"))).alias("signature"), F.element_at(F.array(*map(F.lit, issues.KINDS)), (F.col("n_chars") % 7 + 1).cast("int")).alias("kind"), F.lit(None).cast("string").alias("token"), F.col("doc_id").cast("string").alias("unit_id"), (F.col("n_chars") % 3).alias("occurrences"))
    return issues.kept_first(raw).select("book_id", F.col("issue_ord").cast("long").alias("issue_ord"), "signature", "occurrences", "kind", "unit_id")


def unresolved_issues(spark, sf_dir):
    _, found = prepared(spark, sf_dir, once=True)
    merged = issues.kept_first(found.issues)
    return merged.groupBy("kind").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("signatures"))


def suggestion_tokens(spark, sf_dir):
    _, found = prepared(spark, sf_dir, once=True)
    return issues.suggestions(found.issues).groupBy("token", "line").agg(F.count("*").alias("books"))


def preflight_report(spark, sf_dir):
    plan, found = prepared(spark, sf_dir)
    every = found.issues.unionByName(prepare.warnings_as_issues(plan.warnings, "excluded_by_policy"))
    return prepare.report(plan.units, found, every).withColumn("issues_by_kind", F.to_json("issues_by_kind"))


def phoneme_tokens(spark, sf_dir):
    words = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(T.tokens("text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", "n", F.array_join(P.token_ids("word").cast("array<string>"), " ").alias("ids"), F.array_join(P.unsupported("word"), "").alias("unsupported"))


def archive_paths(spark, sf_dir):
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    reference = F.concat(F.repeat(F.lit("../"), (F.col("page_id") % 4).cast("int")), F.col("path"), F.when(F.col("page_id") % 3 == 0, "%20x%C3%A9").when(F.col("page_id") % 7 == 1, "%zz").otherwise(""), F.lit("?q=1#f"))
    return urls.select("page_id", S.archive_path(F.lit("a/b"), reference).alias("resolved"), S.percent_decoded(reference).alias("decoded"))


def html_blocks(spark, sf_dir):
    """Blocks of the raw web pages, with the section that each stands in."""
    from .sources.html import import_html
    from .sources.model import import_with, unnested

    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("book_id"), F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    found = unnested(import_with(files, import_html)).blocks
    return found.select(F.col("book_id").cast("long").alias("page_id"), "section_id", "block_ord", "kind", F.coalesce("text", "caption", "alt_text").alias("text"))


def voices(spark, sf_dir):
    from .sources.static import voices as table

    return table(spark)


def queries() -> dict[str, Query]:
    named = [
        narration_totals, speech_normalize, repair_counts_by_rule, sentence_split, conversation_sentences, greedy_chunks, pack_sentences, whole_text_paragraphs, ascii_fold, txt_sections, txt_blocks, section_word_counts,
        narration_units, unit_timeline, cue_intervals, page_cues_forward_asof, visible_chapters, chapter_islands, cache_hits, manifest_counts, page_labels_backward_asof, outline_assignment, clamped_levels, section_parents,
        issue_dedup_keep_first, unresolved_issues, suggestion_tokens, preflight_report, phoneme_tokens, archive_paths, html_blocks, voices,
    ]
    return {f.__name__: f for f in named}
