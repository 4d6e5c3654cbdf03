"""Removal of word passages that occur more than once, by Rabin-Karp hashes of every fixed-length window.

Words are hashed to 64 bits; a window's hash is its polynomial modulo 2**64, taken from running sums, so every window
costs a few vector operations. Windows are cut into units of a bounded number. A unit settles its own repeats and
sends each distinct hash once, packed with its place, to the hash's bucket; a bucket finds the hashes that several
units have and answers with their places; the units' places merge into maximal intervals of each document. A passage
that every document has is thus one hash from each unit. The texts are read again at the end for the words that stay.

Defined results: a null text has no words; texts with fewer words than a window lose nothing; repeated rows are
copies of each other and lose every window; copies inside one document count, overlapping or not; null ids are kept;
other columns are left out; an empty table gives an empty one. Two windows count as equal if their 64-bit hashes agree
and so do 8 bits and the bucket of a second polynomial over other word hashes (all 64 bits of it inside a unit): with
``b`` buckets, among ``n`` windows the chance that any two different ones agree is about n*n / (2**73 * b), 0.01 for
the 1.6e13 windows and 1.6 million buckets of 100 TB. The input must return its rows in one order each time it is read, as files and
written tables do.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, decoded, mixed, parts, session, written

WINDOW = 35
#: Windows of a unit, and of one where there are so many buckets that it would send each next to nothing.
UNIT, LARGE_UNIT, EACH = 2_000_000, 8_000_000, 16
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_known = WordHashes()
_powers: dict[int, list[np.ndarray]] = {}


def powers(n: int, base: int) -> list[np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse modulo 2**64."""
    kept = _powers.get(base)
    if kept is None or len(kept[0]) < n:
        size, kept = max(n, 2 * len(kept[0]) if kept else 0, 1 << 12), []
        for factor in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, factor, np.uint64)
            p[0] = 1
            kept.append(np.cumprod(p, dtype=np.uint64))
        _powers[base] = kept
    return [p[:n] for p in kept]


def window_hashes(words: np.ndarray, window: int = WINDOW, base: int = BASES[0]) -> np.ndarray:
    """Rabin-Karp hashes of all windows over word hashes, finally mixed so that any of their bits can choose a bucket."""
    n = len(words) - window + 1
    if n < 1:
        return np.empty(0, np.uint64)
    up, down = powers(len(words) + 1, base)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * down[:-1], dtype=np.uint64)))
    return mixed((sums[window:] - sums[:n]) * up[:n])


def two_hashes(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of all windows, the hash and a second one over other hashes of the words."""
    return window_hashes(words, window), window_hashes(mixed(words ^ np.uint64(BASES[1])), window, BASES[1])


def runs_of_equal(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs together, in the order of their places, and whether each equals the one before it."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    same = np.concatenate((np.zeros(min(1, len(a)), bool), a[1:] == a[:-1]))
    apart = same.copy()
    apart[1:] &= b[1:] != b[:-1]
    if apart.any():  # different windows share the first hash, which hardly ever happens
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
        same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return order, same


def pack_places(places: np.ndarray, kind: type) -> bytes:
    """Ascending places as steps of a small type; a full step carries over to the next."""
    full = int(np.iinfo(kind).max)
    steps = np.diff(places, prepend=0)
    more = steps // full
    out = np.full(len(steps) + int(more.sum()), full, kind)
    out[np.arange(len(steps)) + np.cumsum(more)] = steps % full
    return out.tobytes()


def unpack_places(packed: bytes, kind: type) -> np.ndarray:
    steps = np.frombuffer(packed, kind)
    return np.cumsum(steps, dtype=np.int64)[steps != np.iinfo(kind).max]


def step_type(buckets: int) -> type:
    return np.uint8 if buckets <= 128 else np.uint16 if buckets <= 1 << 15 else np.uint32


_ROW = pa.schema([("bucket", pa.int32()), ("unit", pa.string()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_DDL = "bucket int, unit string, kind int, a binary, b binary"
HASHES, PLACES, LAYOUT = 0, 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in _ROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW)], schema=_ROW)


def _unit(name: str, hashes: np.ndarray, checks: np.ndarray, layout: bytes, buckets: int) -> list[tuple]:
    """What a unit sends: its own repeats, each distinct hash with its first place, and its layout."""
    kind, rows = step_type(buckets), [(zlib.crc32(name.encode()) % buckets, name, LAYOUT, layout, b"")]
    order, again = runs_of_equal(hashes, checks)
    own = again.copy()
    own[:-1] |= again[1:]  # the first of a run too
    if own.any():
        rows.append((zlib.crc32(name.encode()) % buckets, name, PLACES, pack_places(np.sort(order[own]), kind), b""))
    place = np.sort(order[~again])
    code, check = hashes[place], checks[place]
    bucket = (check >> np.uint64(32)) % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        at = by[cuts[k] : cuts[k + 1]]
        rows.append((int(k), name, HASHES, code[at].tobytes() + check[at].astype(np.uint8).tobytes(), pack_places(place[at], kind)))
    return rows


def _units(buckets: int, window: int, unit: int, bits: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held, total, layout = TaskContext.get().partitionId(), 0, [], 0, []

        def close():
            sizes = np.array([x[2] for x in layout], np.int64)
            keys = np.array([x[:2] for x in layout], np.int64).reshape(-1, 2)
            packed = np.column_stack([keys, sizes]).tobytes()
            hashes, checks = (np.concatenate(x) for x in zip(*held))
            return _rows(_unit(f"{part}-{serial}-{zlib.crc32(packed)}", hashes, checks, packed, buckets))

        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), decoded(batch.column(2))):
                hashes, checks = two_hashes(_known.of(text.split()), window)
                if not len(hashes):
                    continue
                held.append((hashes >> np.uint64(64 - bits), checks))
                layout.append((doc_id, key, len(hashes)))
                total += len(hashes)
                if total >= unit:
                    yield close()
                    serial, held, total, layout = serial + 1, [], 0, []
        if layout:
            yield close()

    return run


def _meet(buckets: int):
    """Answer every unit of a bucket with the places of the hashes that another unit has too."""
    kind = step_type(buckets)

    def answers(rows: list[tuple[str, bytes, bytes]]) -> Iterator[tuple]:
        sizes = [len(a) // 9 for _, a, _ in rows]
        hashes = np.concatenate([np.frombuffer(a, np.uint64, n) for (_, a, _), n in zip(rows, sizes)])
        checks = np.concatenate([np.frombuffer(a, np.uint8, n, 8 * n) for (_, a, _), n in zip(rows, sizes)])
        order, again = runs_of_equal(hashes, checks)
        repeated = np.zeros(len(hashes), bool)
        repeated[order] = again
        repeated[order[:-1]] |= again[1:]
        at = 0
        for unit, a, b in rows:
            flags = repeated[at : at + len(a) // 9]
            at += len(a) // 9
            if flags.any():
                yield -1, unit, PLACES, pack_places(unpack_places(b, kind)[flags], kind), b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list] = {}
        for batch in batches:
            passed = []
            for bucket, unit, what, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if what == HASHES:
                    met.setdefault(bucket, []).append((unit, a, b))
                else:
                    passed.append((-1, unit, what, a, b))
            yield _rows(passed)
        for rows in met.values():
            yield _rows(list(answers(rows)))

    return run


def _intervals(buckets: int, window: int):
    kind = step_type(buckets)
    out = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32()))])

    def of(group: pa.Table) -> pa.Table:
        layout = np.empty((0, 3), np.int64)
        places = []
        for what, a in zip(group["kind"].to_pylist(), group["a"].to_pylist()):
            if what == LAYOUT:
                layout = np.frombuffer(a, np.int64).reshape(-1, 3)
            else:
                places.append(unpack_places(a, kind))
        ends = np.cumsum(layout[:, 2])
        repeated = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
        for p in places:
            repeated[p] = True
        rows = []
        for (doc, key, size), end in zip(layout.tolist(), ends.tolist()):
            flags = repeated[end - size : end]
            if flags.any():
                cover = np.zeros(size + window, np.int32)
                cover[:size] += flags
                cover[window:] -= flags
                edge = np.diff(np.concatenate(([0], np.cumsum(cover)[:-1] > 0, [0])).astype(np.int8))
                rows.append((doc, key, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
        columns = list(zip(*rows)) if rows else [[], [], [], []]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return of


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, id, key, text``: ``id`` and ``key`` are never null and tell different rows apart."""
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return columns.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("key"), "text")


def repeated_intervals(docs: DataFrame, window: int = WINDOW, unit: int | None = None, bits: int = 64) -> DataFrame:
    """``id, key, starts, stops`` of each document of ``keyed`` that has repeated windows: the word ranges to remove.

    ``bits`` of the first hash are used; fewer force it to agree for different windows.
    """
    session(docs.sparkSession)
    buckets = parts(docs, 32 << 20)
    unit = unit or min(LARGE_UNIT, max(UNIT, EACH * buckets))
    sent = docs.select("id", "key", "text").mapInArrow(_units(buckets, window, unit, bits), _DDL)
    met = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_meet(buckets), _DDL)
    return met.groupBy("unit").applyInArrow(_intervals(buckets, window), "id long, key long, starts array<int>, stops array<int>")


def without_repeats(docs: DataFrame, window: int = WINDOW, unit: int | None = None, bits: int = 64) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row, and ``kept_sha256``; ``kept`` joins words by one space."""
    rows = keyed(docs)
    found = written(repeated_intervals(rows, window, unit, bits), "intervals").dropDuplicates(["id", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, starts, stops in zip(batch.column(0).to_pylist(), decoded(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                kept = words
                if starts:
                    kept = [w for i, j in zip([0, *stops], [*starts, len(words)]) for w in words[i:j]]
                joined = b" ".join(kept)
                out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = rows.join(found, ["id", "key"], "left").select("doc_id", "text", "starts", "stops")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
