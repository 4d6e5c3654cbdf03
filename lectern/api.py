"""The commands as functions: inspect, preflight, convert and voices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import build, cache, issues, lookup, prepare
from .operators.synthesis import Settings
from .plans import narration, sidecar, timeline
from .sources.files import hashes, import_files, read_files
from .sources.schema import Library
from .sources.sinks import joined_lines, write_files
from .sources.static import voices as voice_table
from .storage import written


@dataclass
class Preflight:
    report: DataFrame
    issues: DataFrame
    suggestions: DataFrame
    prepared: DataFrame
    chapter_texts: DataFrame
    #: prepared units as lines of JSON, the header first
    lines: DataFrame


@dataclass
class Timeline:
    units: DataFrame
    cues: DataFrame
    chapters: DataFrame
    navigation: DataFrame
    manifest: DataFrame
    metadata: DataFrame
    #: the manifest with its sources and settings, as JSON
    provenance: DataFrame


def load(spark: SparkSession, path: str) -> Library:
    """The library of all files below a folder; what can't be read is in ``rejects``. Contents are hashed now, as they may change later."""
    files = read_files(spark, path)
    library = import_files(files)
    library.hashes = written(hashes(files), "hashes")
    library.sections, library.blocks = written(library.sections, "sections"), written(library.blocks, "blocks")
    return library


def inspect(library: Library) -> DataFrame:
    """The tree of each book, a line a section, by ``preorder``."""
    return sidecar.inspection(library.books, library.sections, library.blocks)


def _header(library: Library, settings: Settings, identity: cache.Identity) -> DataFrame:
    """What a prepared table must agree with to serve a build of these settings."""
    known = library.hashes if library.hashes is not None else library.books.select("book_id", F.lit(None).cast("string").alias("sha256"))
    fixed = {"profile": identity.provider, "provider_configuration_hash": identity.configuration, "normalization_version": build.NORMALIZATION, "max_phonemes": settings.max_phonemes, "max_characters": settings.max_characters}
    return library.books.select("book_id").join(known, "book_id", "left").select("book_id", F.col("sha256").alias("source_sha256"), *[F.lit(v).alias(k) for k, v in fixed.items()])


def preflight(library: Library, lexicon: DataFrame | None = None, pronunciations: DataFrame | None = None, footnotes: str = "inline", settings: Settings = Settings(), identity: cache.Identity = cache.Identity()) -> Preflight:
    """All problems of all books in one go, and units that are ready to be spoken."""
    if pronunciations is not None and not prepare.bad_pronunciations(pronunciations).isEmpty():
        raise ValueError("pronunciations must be one word and phonemes of the vocabulary")
    plan = narration.plan(library, footnotes, written)
    found = prepare.prepare(plan.units, lexicon, pronunciations, settings.max_characters, settings.max_phonemes)
    units, said, own = written(found.units, "prepared"), written(found.sentences, "sentences"), written(found.issues, "issues")
    parsed = library.books.select("book_id", F.posexplode("warnings").alias("warning_ord", "warning"))
    late = 1 << 40
    every = prepare.warnings_as_issues(parsed, "source_parse_warning").unionByName(prepare.warnings_as_issues(plan.warnings, "excluded_by_policy").withColumn("issue_ord", F.col("issue_ord") + late)).unionByName(own.withColumn("issue_ord", F.col("issue_ord") + 2 * late))
    report = prepare.report(plan.units, prepare.Prepared(units, said, own), every)
    header = _header(library, settings, identity).join(report.select("book_id", "complete"), "book_id", "left").select("book_id", F.lit(sidecar.SCHEMA_VERSION).alias("schema_version"), F.coalesce("complete", F.lit(True)).alias("complete"), "source_sha256", "profile", "provider_configuration_hash", "normalization_version", "max_phonemes", "max_characters")
    return Preflight(report, issues.kept_first(every), issues.suggestions(own), units, lookup.chapter_texts(units), sidecar.prepared_lines(header, units))


def unusable(library: Library, lines: DataFrame, footnotes: str = "inline", settings: Settings = Settings(), identity: cache.Identity = cache.Identity()) -> DataFrame:
    """``book_id, reason`` of books whose prepared ``lines(book_id, line_no, line)`` don't serve a build: unfinished, of another source, other settings or another plan."""
    headers, units = sidecar.read_prepared(lines)
    differences = prepare.mismatches(narration.plan(library, footnotes, written).units, units)
    return build.unusable(headers, _header(library, settings, identity), differences)


def convert(library: Library, settings: Settings = Settings(), footnotes: str = "inline", policy: str = "auto", provider: timeline.Provider = timeline.mock_samples, identity: cache.Identity = cache.Identity(), stored: DataFrame | None = None) -> Timeline:
    """When everything is heard: units, cues, chapters and the files that go beside the sound."""
    plan = narration.plan(library, footnotes, written)
    units = written(timeline.rendered(plan.units, settings.max_characters, settings.sample_rate, settings.pause_ms, provider), "rendered")
    lengths, cues = timeline.durations(units, settings.sample_rate), written(timeline.timed_cues(plan.cues, units, settings.sample_rate), "cues")
    pages = timeline.page_cues(library.pages, units, settings.sample_rate)
    chapters = timeline.chapters(library.sections, cues, library.books, lengths, policy)
    texts = narration.section_texts(library.sections, library.blocks)
    asked = cache.hits(cache.requests(units, settings.max_characters, identity), stored)
    numbers = written(sidecar.counts(texts, units, asked), "counts")
    known = library.hashes if library.hashes is not None else library.books.select("book_id", F.lit(None).cast("string").alias("sha256"))
    provenance = sidecar.manifest(library.books, known, numbers, lengths, plan.warnings, settings, identity, footnotes=footnotes, policy=policy)
    return Timeline(units, timeline.ordered(cues, pages), chapters, sidecar.navigation(library.books, library.sections, cues, pages, lengths), numbers, sidecar.chapter_metadata(library.books, chapters), provenance)


def save(found: Preflight | Timeline, folder: str) -> DataFrame:
    """Write the files of a result below ``folder``, one set a book, each whole or not at all; ``name, bytes`` of what was written.

    Of a preflight: ``<book_id>.report.json``, ``.prepared.jsonl``, ``.suggestions.txt`` and a folder of chapter texts.
    Of a conversion: ``<book_id>.navigation.json``, ``.manifest.json`` and ``.chapters.txt``.
    """
    named = lambda df, ending, content="content": df.select(F.concat("book_id", F.lit(ending)).alias("name"), F.col(content).alias("content"))
    if isinstance(found, Timeline):
        files = named(found.navigation, ".navigation.json", "json").unionByName(named(found.provenance, ".manifest.json", "json")).unionByName(named(found.metadata, ".chapters.txt", "text"))
    else:
        entry = F.struct("issue_ord", *[c for c in found.issues.columns if c not in ("book_id", "issue_ord")])
        listed = found.issues.groupBy("book_id").agg(F.array_sort(F.collect_list(entry)).alias("issues"))
        report = found.report.join(listed, "book_id", "left").withColumn("issues", F.coalesce("issues", F.array().cast(listed.schema["issues"].dataType)))
        report = report.select("book_id", F.to_json(F.struct(*[c for c in report.columns if c != "book_id"]), {"ignoreNullFields": "false"}).alias("content"))
        suggested = found.suggestions.select("book_id", F.lit(1).alias("at"), "line").unionByName(found.report.select("book_id", F.lit(0).alias("at"), F.lit("# Words without a pronunciation. Look them over before use.").alias("line")))
        texts = found.chapter_texts.select(F.concat("book_id", F.lit("/"), "file_name").alias("name"), F.regexp_replace("text", r"\s+\z", "").alias("content"))
        lines = suggested.withColumn("order", F.concat(F.col("at").cast("string"), "line"))
        files = named(report, ".report.json").unionByName(named(joined_lines(found.lines, "book_id", "line_no", "line"), ".prepared.jsonl")).unionByName(named(joined_lines(lines, "book_id", "order", "line"), ".suggestions.txt")).unionByName(texts)
    return written(write_files(files, folder), "saved")


def voices(spark: SparkSession) -> DataFrame:
    return voice_table(spark)
