"""Tables that go beside the sound: navigation, manifest, prepared units and reports, as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_metadata, word_count
from ..operators.build import NORMALIZATION

SCHEMA_VERSION = 1
VERSION = "0.2"


def toc(sections: DataFrame, cues: DataFrame) -> DataFrame:
    """Sections with the times of their cue; ``narrated`` says if there is one. Of several cues the last counts."""
    last = cues.filter("cue_id like 'section:%' and section_id is not null").groupBy("book_id", "section_id").agg(F.max_by(F.struct("start_ms", "end_ms"), "cue_ord").alias("c"))
    met = sections.filter("preorder > 0").join(last, ["book_id", "section_id"], "left")
    return met.select("book_id", "section_id", "parent_id", "preorder", "depth", "kind", "title", "source_id", "start", "stop", F.col("c.start_ms").alias("start_ms"), F.col("c.end_ms").alias("end_ms"), F.col("c").isNotNull().alias("narrated"))


def _opened(value: Column) -> Column:
    """A struct as a JSON object whose last brace is still to come."""
    return F.regexp_replace(F.to_json(value, {"ignoreNullFields": "false"}), r"\}\z", "")


def position_json(position: str) -> Column:
    """A position with its type and that type's own fields, nulls included; null for a null position."""
    own = lambda *names: F.to_json(F.struct(*[F.col(f"{position}.{n}") for n in ("type", *names)]), {"ignoreNullFields": "false"})
    kind = F.col(f"{position}.type")
    return F.when(kind.isin("text", "kindle"), own("byte_offset")).when(kind == "epub", own("resource", "fragment", "character_offset")).when(kind == "pdf", own("page_number", "character_offset"))


def range_json(start: str = "start", stop: str = "stop") -> Column:
    """The range from ``start`` up to ``stop`` in ``source_id``, or null as JSON."""
    found = F.concat(_opened(F.struct("source_id")), F.lit(',"start":'), position_json(start), F.lit(',"end":'), position_json(stop), F.lit("}"))
    return F.coalesce(found, F.lit("null"))


def _ranged(fields: list, start: str = "start", stop: str = "stop") -> Column:
    return F.concat(_opened(F.struct(*fields)), F.lit(',"source_range":'), range_json(start, stop))


def _listed(rows: DataFrame, order: list[str], entry: Column, name: str, between: str = ",") -> DataFrame:
    pieces = F.array_sort(F.collect_list(F.struct(*order, entry.alias("v"))))
    return rows.groupBy("book_id").agg(F.array_join(F.transform(pieces, lambda x: x["v"]), between).alias(name))


def nested_toc(contents: DataFrame) -> DataFrame:
    """``book_id, toc``: the entries of ``toc`` as nested JSON, without the brackets around all.

    No tree is built: in preorder, the depth of the next entry tells whether an entry opens its children or how many
    lists end with it.
    """
    order = Window.partitionBy("book_id").orderBy("preorder")
    following = F.lead("depth").over(order)
    rows = contents.withColumn("ends", F.col("depth") - F.coalesce(following, F.lit(1)) + 1).withColumn("more", following.isNotNull())
    kind = F.lower(F.regexp_replace("kind", "(?<=[a-z])([A-Z])", "_$1"))
    head = _ranged([F.col("section_id").alias("id"), kind.alias("type"), "title", "narrated", "start_ms", "end_ms"])
    entry = F.concat(head, F.lit(',"children":['), F.repeat(F.lit("]}"), F.greatest("ends", F.lit(0))), F.when(F.col("more") & (F.col("ends") > 0), ",").otherwise(""))
    return _listed(rows, ["preorder"], entry, "toc", "")


def navigation(books: DataFrame, sections: DataFrame, cues: DataFrame, pages: DataFrame, lengths: DataFrame) -> DataFrame:
    """``book_id, json``: title, duration, nested contents, pages, paragraphs and sentences by start. One book is one document."""
    mapping = F.concat(_ranged([F.col("cue_id").alias("id"), "start_ms", "end_ms", "section_id"]), F.lit("}"))
    page = F.concat(_ranged([F.col("cue_id").alias("id"), "label", "start_ms"], "position", "position"), F.lit("}"))
    parts = {
        "toc": nested_toc(toc(sections, cues)), "pages": _listed(pages, ["start_ms", "page_ord"], page, "pages"),
        "paragraphs": _listed(cues.filter("kind = 'Paragraph'"), ["start_ms", "cue_ord"], mapping, "paragraphs"), "sentences": _listed(cues.filter("kind = 'Sentence'"), ["start_ms", "cue_ord"], mapping, "sentences"),
    }
    met = books.select("book_id", F.coalesce("title", F.lit("Untitled")).alias("title")).join(lengths, "book_id", "left")
    for part in parts.values():
        met = met.join(part, "book_id", "left")
    head = _opened(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "title", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms")))
    lists = [x for name in parts for x in (F.lit(f',"{name}":['), F.coalesce(name, F.lit("")), F.lit("]"))]
    return met.select("book_id", F.concat(head, *lists, F.lit("}")).alias("json"))


def manifest(books: DataFrame, hashes: DataFrame, numbers: DataFrame, lengths: DataFrame, warnings: DataFrame, settings, identity, repairs: DataFrame | None = None, footnotes: str = "inline", policy: str = "auto", pronunciations: tuple[str, ...] = (), outputs: tuple[str, ...] = (), stamp: int = 0) -> DataFrame:
    """``book_id, json``: where a build comes from, how it was asked for, and its ``numbers`` (rows of ``counts``).

    ``hashes(book_id, sha256)`` are those of the files, ``warnings(book_id, warning_ord, warning)`` those of the plan and
    ``repairs(book_id, automatic_repairs)`` those of the report; a book that lacks them has none.
    """
    left_out = F.transform(F.array_sort(F.collect_list(F.struct("warning_ord", "warning"))), lambda x: x["warning"])
    none = F.array().cast("array<string>")
    met = books.join(hashes, "book_id", "left").join(numbers, "book_id", "left").join(lengths, "book_id", "left").join(warnings.groupBy("book_id").agg(left_out.alias("left_out")), "book_id", "left")
    met = met.join(repairs.select("book_id", "automatic_repairs"), "book_id", "left") if repairs is not None else met.withColumn("automatic_repairs", F.lit(0))
    fixed = lambda **values: [F.lit(v).alias(k) for k, v in values.items()]
    listed = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    mended = F.coalesce(F.col("automatic_repairs").cast("long"), F.lit(0))
    cover = F.when(F.col("cover").isNotNull(), F.struct(F.col("cover.source_id").alias("source_id"), F.col("cover.media_type").alias("media_type"), F.octet_length("cover.content").alias("bytes")))
    omitted = F.coalesce("left_out", none)
    document = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(stamp).cast("long").alias("build_timestamp_unix_seconds"), F.struct(*fixed(name="lectern", version=VERSION, importer_version=VERSION)).alias("tool"),
        F.struct(F.col("path").alias("file"), "sha256", "format", "format_version").alias("source"), F.struct("title", "authors", "language", cover.alias("cover")).alias("metadata"),
        F.struct(
            *fixed(provider=identity.provider, model=identity.model, voice=identity.voice), F.lit(identity.language or None).cast("string").alias("language"), *fixed(configuration_hash=identity.configuration, speed=settings.speed, footnotes=footnotes, pause_ms=settings.pause_ms, max_retries=settings.retries),
            listed(pronunciations).alias("pronunciation_overrides"), F.lit(NORMALIZATION).alias("phoneme_normalization_version"), F.struct(mended.alias("count"), F.struct(mended.alias("syllabic_consonant")).alias("by_rule")).alias("automatic_repairs"),
            *fixed(provider_character_limit=settings.max_characters, sample_rate=settings.sample_rate),
        ).alias("narration"),
        F.struct(*fixed(container="m4b", codec="aac", bitrate_bps=64_000, channels=1)).alias("encoding"), F.lit(policy).alias("chapter_policy"), omitted.alias("omitted_or_skipped"), F.concat("warnings", omitted).alias("warnings"), listed(outputs).alias("output_files"),
        F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("source_words", "narrated_words", "narrated_characters")], F.coalesce(F.col("units").cast("long"), F.lit(0)).alias("narration_units"), *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("provider_chunks", "cache_hits", "generated_chunks")]).alias("counts"),
    )
    return met.select("book_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("json"))


def counts(texts: DataFrame, units: DataFrame, asked: DataFrame) -> DataFrame:
    """The manifest's numbers of each book: source and spoken words and characters, units, requests and hits."""
    spoken = units.groupBy("book_id").agg(F.sum(word_count("text")).alias("narrated_words"), F.count("*").alias("units"), (F.sum(F.char_length("text")) + F.count("*") - 1).alias("narrated_characters"))
    made = asked.groupBy("book_id").agg(F.count("*").alias("provider_chunks"), F.sum(F.col("hit").cast("int")).alias("cache_hits"))
    met = texts.select("book_id", F.col("words").alias("source_words"), F.char_length("text").alias("source_characters")).join(spoken, "book_id", "left").join(made, "book_id", "left")
    return met.fillna(0, ["narrated_words", "units", "narrated_characters", "provider_chunks", "cache_hits"]).withColumn("generated_chunks", F.col("provider_chunks") - F.col("cache_hits"))


def prepared_lines(header: DataFrame, units: DataFrame) -> DataFrame:
    """``book_id, line_no, line``: a header and a unit a line, as JSON; write in the order of ``line_no``."""
    top = header.select("book_id", F.lit(0).cast("long").alias("line_no"), F.to_json(F.struct(F.lit("metadata").alias("kind"), *[c for c in header.columns if c != "book_id"])).alias("line"))
    rest = units.select("book_id", (F.col("unit_ord") + 1).cast("long").alias("line_no"), F.to_json(F.struct(F.col("unit_id").alias("id"), "section_id", "status", "original_text", F.col("text").alias("tts_text"), "phoneme_chunks")).alias("line"))
    return top.unionByName(rest)


def read_prepared(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header and units of ``book_id, line_no, line``; empty lines are passed over; ``unit_id`` may stand for ``id``, and a missing status is ready."""
    head = "kind string, schema_version int, complete boolean, source_sha256 string, profile string, provider_configuration_hash string, normalization_version int, max_phonemes int, max_characters int"
    unit = "id string, unit_id string, section_id string, status string, original_text string, tts_text string, phoneme_chunks array<string>"
    full = lines.filter("trim(line) <> ''")
    kind = F.get_json_object("line", "$.kind")
    headers = full.filter(kind == "metadata").select("book_id", F.from_json("line", head).alias("h")).select("book_id", "h.*")
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("line_no")) - 1
    units = full.filter(kind.isNull() | (kind != "metadata")).select("book_id", order.alias("unit_ord"), F.from_json("line", unit).alias("u"))
    return headers, units.select("book_id", "unit_ord", F.coalesce("u.id", "u.unit_id").alias("unit_id"), "u.section_id", F.coalesce("u.status", F.lit("ready")).alias("status"), "u.original_text", F.col("u.tts_text").alias("text"), "u.phoneme_chunks")


def chapter_metadata(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """``book_id, text``: a metadata file with the book's title and authors and its chapters in milliseconds."""
    entry = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), escape_metadata("title"), F.lit("\n"))
    listed = chapters.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_ord", entry.alias("e")))), lambda x: x["e"]), "").alias("entries"))
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), escape_metadata(F.coalesce("title", F.lit("Untitled"))), F.lit("\n"), F.when(F.size("authors") > 0, F.concat(F.lit("artist="), escape_metadata(F.array_join("authors", "; ")), F.lit("\n"))).otherwise(""))
    return books.join(listed, "book_id", "left").select("book_id", F.concat(head, F.coalesce("entries", F.lit(""))).alias("text"))


def inspection(books: DataFrame, sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """``book_id, preorder, line``: the tree of a book, two blanks a level, with kind, title and number of blocks."""
    own = blocks.groupBy("book_id", "section_id").agg(F.count("*").alias("n"))
    met = sections.join(own, ["book_id", "section_id"], "left")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.concat_ws("|", "section_id", "kind", F.coalesce("title", F.lit("")), F.concat(F.lit("blocks:"), F.coalesce("n", F.lit(0)).cast("string"))))
    return met.join(books.select("book_id"), "book_id", "left_semi").select("book_id", "preorder", line.alias("line"))


