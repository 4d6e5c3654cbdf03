"""Checks of what was built: seconds read from tags, titles and chapters against what was asked for, prepared tables against a build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, col

#: Of the rules that phonemes are normalised by; a prepared table of another version isn't used.
NORMALIZATION = 1


def seconds_to_ms(c: str | Column) -> Column:
    """Whole milliseconds of seconds, halves up; null unless finite and not negative."""
    s = col(c).cast("double")
    return F.when(s.isNotNull() & ~F.isnan(s) & (s >= 0) & (s < float("inf")), F.floor(s * 1000 + 0.5).cast("long"))


def text_to_ms(c: str | Column) -> Column:
    """The same of a text; null if it isn't a plain number."""
    plain = col(c).rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    return F.when(plain, seconds_to_ms(col(c).try_cast("double")))


def tag(tags: str | Column, name: str) -> Column:
    """The value of a map of tags whose name agrees but for the case of A-Z; null if there is none."""
    met = F.map_filter(col(tags), lambda k, _: ascii_lower(k) == name.lower())
    return F.get(F.map_values(met), 0)


def peak(samples: str | Column) -> Column:
    """The largest amplitude; zero without samples."""
    return F.coalesce(F.array_max(F.transform(col(samples), F.abs)), F.lit(0.0)).cast("double")


def unexpected(books: DataFrame, chapters: DataFrame, found: DataFrame, found_chapters: DataFrame) -> DataFrame:
    """``book_id, problem``: what differs between a library and what was read back of its files.

    ``books(book_id, title, authors, has_cover)``, ``found(book_id, title, artist, has_cover)``; chapters of both have
    ``book_id, chapter_ord, title`` and meet by their ordinal.
    """
    artist = F.when(F.size("authors") > 0, F.array_join("authors", "; "))
    asked = books.select("book_id", F.struct("title", artist.alias("artist"), F.coalesce("has_cover", F.lit(False)).alias("has_cover")).alias("asked"))
    given = found.select("book_id", F.struct("title", "artist", F.coalesce("has_cover", F.lit(False)).alias("has_cover")).alias("given"))
    met = asked.join(given, "book_id", "left")
    differs = lambda name: ~F.col(f"asked.{name}").eqNullSafe(F.col(f"given.{name}"))
    told = F.array_compact(F.array(*[F.when(differs(name), F.lit(said)) for name, said in (("title", "the title differs"), ("artist", "the authors differ"), ("has_cover", "a cover is missing or too many"))]))
    about = met.select("book_id", F.explode(told).alias("problem"))
    left, right = (df.select("book_id", "chapter_ord", F.struct("title").alias(side)) for df, side in ((chapters, "asked"), (found_chapters, "given")))
    wrong = left.join(right, ["book_id", "chapter_ord"], "full").filter(~F.col("asked").eqNullSafe(F.col("given"))).join(books.select("book_id"), "book_id", "left_semi")
    return about.unionByName(wrong.select("book_id", F.lit("the chapters differ").alias("problem")).distinct())


def unusable(headers: DataFrame, expected: DataFrame, differences: DataFrame) -> DataFrame:
    """``book_id, reason``: the first reason why a prepared table doesn't serve a build.

    ``headers`` and ``expected`` have a row a book with ``source_sha256, profile, provider_configuration_hash,
    normalization_version, max_phonemes, max_characters``, ``headers`` also ``complete``; ``differences`` are rows of
    ``prepare.mismatches``.
    """
    fields = ("profile", "provider_configuration_hash", "normalization_version", "max_phonemes", "max_characters")
    met = expected.select("book_id", F.struct("source_sha256", *fields).alias("e")).join(headers.select("book_id", "complete", F.struct("source_sha256", *fields).alias("h")), "book_id", "left")
    met = met.join(differences.select("book_id").distinct().withColumn("other", F.lit(True)), "book_id", "left")
    differs = lambda name: ~F.col(f"e.{name}").eqNullSafe(F.col(f"h.{name}"))
    profile = differs(fields[0])
    for name in fields[1:]:
        profile = profile | differs(name)
    reason = (
        F.when(F.col("h").isNull(), "nothing is prepared").when(~F.coalesce("complete", F.lit(False)), "problems are left that block").when(differs("source_sha256"), "the source has changed")
        .when(profile, "it was prepared with other settings").when(F.col("other"), "its units aren't those of the plan")
    )
    return met.select("book_id", reason.alias("reason")).filter("reason is not null")
