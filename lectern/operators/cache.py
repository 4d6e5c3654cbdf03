"""Reuse of earlier results by content: keys, hits, and what is still to be made."""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import pieces

VERSION = b"lectern-segment-v1\0"


@dataclass(frozen=True)
class Identity:
    """What a segment depends on besides its text."""

    provider: str = "mock"
    model: str = "mock"
    voice: str = "mock"
    language: str = ""
    configuration: str = "mock"
    sample_rate: int = 24_000
    speed: float = 1.0


def configuration_hash(**settings) -> str:
    """Of settings by name, each as text with a NUL after it."""
    digest = hashlib.sha256()
    for name in sorted(settings):
        digest.update(f"{name}={settings[name]}".encode() + b"\0")
    return digest.hexdigest()


def segment_key(text: str | Column, identity: Identity = Identity(), phonemes: Column | None = None) -> Column:
    """SHA-256 of the version, the identity, the text, prepared phonemes if any, speed and rate; NUL after each string."""
    head = VERSION + b"".join(x.encode() + b"\0" for x in (identity.provider, identity.model, identity.voice, identity.language, identity.configuration))
    tail = struct.pack("<fI", identity.speed, identity.sample_rate)
    raw = lambda b: F.unhex(F.lit(b.hex()))
    body = [F.encode(F.col(text) if isinstance(text, str) else text, "UTF-8"), raw(b"\0")]
    if phonemes is not None:
        parts = F.concat(F.lit("prepared\0"), F.array_join(F.transform(phonemes, lambda p: F.concat(p, F.lit("\0"))), ""))
        body.append(F.when(phonemes.isNotNull(), F.encode(parts, "UTF-8")).otherwise(raw(b"")))
    return F.sha2(F.concat(raw(head), *body, raw(tail)), 256)


def seed(key: str | Column) -> Column:
    """The first four bytes of a hex key as a little-endian number."""
    k = F.col(key) if isinstance(key, str) else key
    swapped = F.concat(F.substring(k, 7, 2), F.substring(k, 5, 2), F.substring(k, 3, 2), F.substring(k, 1, 2))
    return F.conv(swapped, 16, 10).cast("long")


def requests(units: DataFrame, limit: int, identity: Identity = Identity()) -> DataFrame:
    """``book_id, unit_ord, request_ord, text, key``: each unit's pieces."""
    return units.select("book_id", "unit_ord", F.posexplode(pieces("text", limit)).alias("request_ord", "text")).withColumn("key", segment_key("text", identity))


def hits(asked: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``asked`` with ``hit``: the key is stored, or an earlier request of the book has it."""
    order = Window.partitionBy("book_id", "key").orderBy("unit_ord", "request_ord")
    again = asked.withColumn("hit", F.row_number().over(order) > 1)
    if stored is None:
        return again
    known = stored.select("key", F.lit(True).alias("__known")).distinct()
    return again.join(known, "key", "left").withColumn("hit", F.col("hit") | F.coalesce("__known", F.lit(False))).drop("__known")


def missing(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each key that has to be made: of its requests, the first."""
    todo = asked.join(stored.select("key").distinct(), "key", "left_anti")
    return todo.groupBy("key").agg(F.min_by("text", F.struct("book_id", "unit_ord", "request_ord")).alias("text"))


def usable(segments: DataFrame) -> DataFrame:
    """Stored segments that count: with samples and a rate."""
    return segments.filter("samples > 0 and sample_rate > 0")
