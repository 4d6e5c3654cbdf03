"""Providers of sound as partition functions: bounded retries, one split of a failed piece, checks of what comes back."""

from __future__ import annotations

import hashlib
import io
import struct
import wave
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, col, trim

RATE, RETRIES, MOST_RETRIES = 24_000, 2, 10
#: Fewest and most tokens of a generated piece; twice its characters between.
TOKENS = 96, 640


@dataclass(frozen=True)
class Settings:
    """What a run may be asked for; wrong values are refused before anything starts."""

    speed: float = 1.0
    retries: int = RETRIES
    pause_ms: int = 120
    max_characters: int = 400
    max_phonemes: int = 200
    sample_rate: int = RATE

    def __post_init__(self):
        if not 0.5 <= self.speed <= 2.0:
            raise ValueError("speed must be between 0.5 and 2.0")
        if not 0 <= self.retries <= MOST_RETRIES:
            raise ValueError(f"retries must be between 0 and {MOST_RETRIES}")
        if self.pause_ms < 0 or self.max_characters < 1 or self.sample_rate < 1:
            raise ValueError("pause, character limit and sample rate must be positive")
        if not 1 <= self.max_phonemes <= 510:
            raise ValueError("phoneme limit must be between 1 and 510")


def output_name(name: str) -> str:
    """A base name for files that stays in its folder."""
    if not name.strip() or name in (".", "..") or any(c in name for c in "/\\\0"):
        raise ValueError(f"output name {name!r} is not a plain file name")
    return name


def halves(c: str | Column) -> Column:
    """A piece cut in two at the blank nearest its middle, or at the middle; null if a half would be empty."""
    text = col(c)
    middle = F.floor(F.char_length(text) / 2).cast("int")
    blank = F.transform(F.filter(F.sequence(F.lit(1), F.char_length(text)), lambda k: F.substring(text, k, F.lit(1)).rlike(WS)), lambda k: F.struct(F.abs(k - 1 - middle).alias("away"), (k - 1).alias("at")))
    at = F.coalesce(F.array_min(blank)["at"], middle)
    left, right = trim(F.substring(text, F.lit(1), at)), trim(F.substring(text, at + 1, F.char_length(text)))
    return F.when((F.char_length(text) >= 2) & (left != "") & (right != ""), F.array(left, right))


def split_in_two(text: str) -> tuple[str, str] | None:
    """The same rule for a provider's own process."""
    import re

    middle = len(text) // 2
    at = min((m.start() for m in re.finditer(WS, text)), key=lambda k: abs(k - middle), default=middle)
    left, right = (re.sub(rf"^{WS}+|{WS}+$", "", part) for part in (text[:at], text[at:]))
    return (left, right) if len(text) >= 2 and left and right else None


def most_tokens(c: str | Column) -> Column:
    return F.least(F.greatest(2 * F.char_length(col(c)), F.lit(TOKENS[0])), F.lit(TOKENS[1]))


def generation_seed(text: str, attempt: int) -> int:
    """A seed from the text and the attempt: the first four bytes of their hash, little-endian."""
    digest = hashlib.sha256(b"lectern-seed-v1\0" + text.encode() + b"\0" + struct.pack("<I", attempt)).digest()
    return struct.unpack("<I", digest[:4])[0]


def real_time_factor(synthesis_s: str, audio_s: str) -> Column:
    return F.when(F.col(audio_s) > 0, F.col(synthesis_s) / F.col(audio_s)).otherwise(0.0)


def valid_pcm(c: str | Column) -> Column:
    """Whether all samples are finite and strictly between -1 and 1."""
    return F.forall(col(c), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1.0))


def checked_pcm(samples: np.ndarray) -> np.ndarray:
    if not len(samples) or not np.isfinite(samples).all() or (np.abs(samples) >= 1).any():
        raise ValueError("PCM must have samples, all finite and strictly between -1.0 and 1.0")
    return samples


def to_int16(samples: np.ndarray) -> np.ndarray:
    """Halves are rounded away from zero."""
    scaled = checked_pcm(samples).astype(np.float32) * np.float32(32767)
    return (np.sign(scaled) * np.floor(np.abs(scaled) + np.float32(0.5))).astype("<i2")


def write_wav(out, pieces: Iterable[np.ndarray | int], rate: int = RATE, buffer: int = 4096) -> tuple[int, float]:
    """Write a mono 16-bit file of pieces in order to an open file; a number is that many samples of silence.

    No more than a buffer of the output is held at a time. Returns the samples and the largest amplitude.
    """
    total, loudest = 0, 0.0
    with wave.open(out, "wb") as file:
        file.setparams((1, 2, rate, 0, "NONE", ""))
        for piece in pieces:
            n = piece if isinstance(piece, int) else len(checked_pcm(piece))
            for at in range(0, n, buffer):
                part = min(buffer, n - at)
                if isinstance(piece, int):
                    file.writeframesraw(bytes(2 * part))
                else:
                    loudest = max(loudest, float(np.abs(piece[at : at + part]).max()))
                    file.writeframesraw(to_int16(piece[at : at + part]).tobytes())
            total += n
    return total, loudest


def wav(pieces: Iterable[np.ndarray | int], rate: int = RATE) -> bytes:
    out = io.BytesIO()
    write_wav(out, pieces, rate)
    return out.getvalue()


def wav_samples(content: bytes) -> tuple[int, int] | None:
    """Samples and rate of a stored file; None, a miss, if it isn't one that ``wav`` writes or is empty."""
    try:
        with wave.open(io.BytesIO(content)) as file:
            shape, n = (file.getnchannels(), file.getsampwidth(), file.getcomptype()), file.getnframes()
            return (n, file.getframerate()) if shape == (1, 2, "NONE") and n and file.getframerate() and len(file.readframes(n)) == 2 * n else None
    except (wave.Error, EOFError):
        return None


Synthesize = Callable[[str], np.ndarray]


def with_retries(make: Synthesize, text: str, retries: int = RETRIES, split: bool = False) -> list[np.ndarray]:
    """The sound of a text after at most ``retries`` more tries; with ``split``, a text that fails is cut once and its
    halves are tried once each. The last error is raised."""
    last: Exception | None = None
    for _ in range(1 if split else retries + 1):
        try:
            return [checked_pcm(make(text))]
        except Exception as error:  # a provider may fail in any way
            last = error
    parts = split_in_two(text) if split else None
    if parts is None:
        raise last
    return [checked_pcm(make(part)) for part in parts]


def synthesized(requests: DataFrame, provider: Callable[[], Synthesize], settings: Settings = Settings(), split: bool = False) -> DataFrame:
    """``key, samples, sample_rate, content, error`` for each row of ``requests(key, text)``.

    ``provider`` is called once a partition and may start a process. A piece that fails is a row with its error, so a
    run goes on and the next one makes only what is missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = provider()
        for batch in batches:
            out = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    pieces = with_retries(make, text, settings.retries, split)
                    out.append((key, sum(map(len, pieces)), settings.sample_rate, wav(pieces, settings.sample_rate), None))
                except Exception as error:  # the row keeps it
                    out.append((key, 0, settings.sample_rate, None, str(error)))
            kinds = pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)], ["key", "samples", "sample_rate", "content", "error"])

    return requests.select("key", "text").mapInArrow(run, "key string, samples long, sample_rate int, content binary, error string")
