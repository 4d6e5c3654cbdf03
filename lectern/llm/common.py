"""What the operators of this subpackage share: written tables, batch sizes and word hashes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import purge, shared_dir, spread, written

__all__ = ["purge", "shared_dir", "spread", "written"]

#: Words are runs of anything but these six ASCII blanks; ``bytes.split()`` without arguments cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch. Texts have no length limit, so batches are kept short.
BATCH_ROWS = 256


def session(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch of texts can hold; a lower bound and all other settings are the caller's.

    Spark reads the setting when a result runs, after the operator has returned, so it stays as long as results do.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    return spark


def plan_bytes(df: DataFrame) -> int:
    """The planner's estimate of the size of ``df``; for files, their size. Reads nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts(df: DataFrame, bytes_each: int = 8 << 20, largest: int = 64 << 20) -> int:
    """Partitions for a shuffle of ``df``: at least the session's number.

    A partition takes ``bytes_each``; beyond 4096 of them it grows with the input, up to ``largest``, and stays there.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = plan_bytes(df)
    each = min(max(bytes_each, size // 4096), largest)
    return max(least, math.ceil(size / each)) if size < 1 << 60 else least


#: Shares of all rows above which a key is hot: there are at most this many such keys, however many rows there are.
HOT_KEYS = 10_000
#: Rows of a key that one task takes without a thought.
HOT_ROWS = 4096


def joined_evenly(rows: DataFrame, table: DataFrame, keys: list[str], copies: str, total: int) -> DataFrame:
    """``rows`` inner joined with ``table``, which has one row of each key, and ``copies`` tells how many ``rows`` it meets.

    Keys of more than ``HOT_ROWS`` rows and a ``HOT_KEYS``-th of all are at most ``HOT_KEYS`` many: their rows of
    ``table`` are broadcast and ``rows`` stay where they are. The others are shuffled; none fills a task.
    ``copies`` is left out. ``rows`` are read twice, so they should be a written table.
    """
    hot = F.col(copies) > max(HOT_ROWS, total // HOT_KEYS)
    few, many = table.filter(hot).drop(copies), table.filter(~hot).drop(copies)
    if few.isEmpty():
        return rows.join(many, keys)
    columns = [*keys, *[c for c in rows.columns if c not in keys], *[c for c in few.columns if c not in keys]]
    cold = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(many, keys)
    return rows.join(F.broadcast(few), keys).select(*columns).unionByName(cold.select(*columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one with fewer splits than cores is dealt to all of them."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def bucket_of(doc_id, modulus: int):
    """crc32 of the id's decimal text, mod ``modulus``: the folds that the contracts fix. Null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def decoded(values) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string array; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in values.cast(pa.large_binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, kept for the worker's next batches up to a bound."""

    def __init__(self, bound: int = 300_000):
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxh64_intdigest(word, 0x5EED)
        return value

    def of(self, words: list[bytes]):
        import numpy as np

        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x):
    """A bijection of 64-bit words that spreads every bit over all others (numpy, wraps around)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
