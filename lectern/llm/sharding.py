"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered in the order of (doc_id, text checksum, size), equal ones in any order; a balanced Feistel network over the least even
number of bits that covers the count, walked until the value is below it, permutes the numbers. The permuted number
``p`` gives shard ``p mod shards`` and slot ``p div shards``, so counts differ by one at most, slots have no gaps and
anyone can compute where row ``n`` went. Law: ``rows``.

Defined results: a null text has no bytes; rows alike in id, checksum and size may trade places; null ids come first;
other columns are left out; an empty table gives an empty one; the result depends on the rows and the seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, parts, session, written

SHARDS, SEED, ROUNDS, OVERHEAD = 40, 2024, 6, 16
#: Ranges that rows are numbered in, at most: one row each is broadcast.
RANGES = 1 << 16


def permuted(numbers: np.ndarray, count: int, seed: int = SEED) -> np.ndarray:
    """The permutation of ``range(count)`` at ``numbers``."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    shift, low = np.uint64(half), np.uint64((1 << half) - 1)
    keys = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    value = numbers.astype(np.uint64)
    walking = np.arange(len(value))
    while len(walking):
        x = value[walking]
        left, right = x >> shift, x & low
        for key in keys:
            left, right = right, left ^ (mixed(right ^ key) & low)
        value[walking] = left << shift | right
        walking = walking[value[walking] >= np.uint64(count)]
    return value.astype(np.int64)


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with ``number``, gapless from 0 in the order of ``by``; ranges are counted, and one sum a range is kept."""
    spark = session(rows.sparkSession)
    ranged = rows.repartitionByRange(min(RANGES, parts(rows)), *by).sortWithinPartitions(*by)
    names = [*rows.columns, "piece", "within"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, piece, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], names)
            at += n

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    walked = written(ranged.mapInArrow(run, f"{schema}, piece int, within long"), "walked")
    first, starts = 0, []
    for piece, n in sorted(walked.groupBy("piece").count().collect()):  # one row a range
        starts.append((piece, first))
        first += n
    begins = spark.createDataFrame(starts, "piece int, begin long")
    return walked.join(F.broadcast(begins), "piece").select(*rows.columns, (F.col("begin") + F.col("within")).alias("number"))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The contract's columns and ``number`` for every row. Texts are read once and don't move."""
    text = docs["text"].cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    # a place in the input as the last key, so that rows alike in all others, however many, are cut into ranges too
    rows = written(columns.withColumn("tie", F.monotonically_increasing_id()), "sizes")
    count = rows.count()
    known = numbered(rows, ["doc_id", "text_crc32", "size", "tie"]).drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = permuted(batch.column(3).to_numpy(zero_copy_only=False), count, seed)
            n = len(to)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(["rows"] * n, pa.string()), pa.array((to % shards).astype(np.int32)), pa.array(to // shards), pa.nulls(n, pa.int32()), batch.column(3)],
                ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "number"],
            )

    return known.mapInArrow(run, "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, number long")
