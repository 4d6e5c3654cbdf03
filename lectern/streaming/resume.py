"""Prepared units as a stream: each batch makes only the segments that no earlier batch or run has stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cache
from ..operators.synthesis import Settings

UNIT = "id string, unit_id string, section_id string, status string, tts_text string, kind string"


def unit_stream(spark: SparkSession, folder: str, files_each: int = 100) -> DataFrame:
    """``book_id, unit_id, text`` of the units in files of JSON lines as they arrive; the file's name is the book."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_each).load(folder).withColumn("path", F.col("_metadata.file_path"))
    read = lines.filter("trim(value) <> ''").select("path", F.from_json("value", UNIT).alias("u")).filter("u.kind is null or u.kind <> 'metadata'")
    return read.filter(F.coalesce("u.status", F.lit("ready")) == "ready").select(F.regexp_extract("path", r"([^/]+)\.[^./]*\z", 1).alias("book_id"), F.coalesce("u.id", "u.unit_id").alias("unit_id"), F.col("u.tts_text").alias("text"))


def mock_segments(todo: DataFrame, rate: int) -> DataFrame:
    """``key, samples, sample_rate``: ten samples a character."""
    return todo.select("key", F.greatest(F.char_length("text") * 10, F.lit(1)).cast("long").alias("samples"), F.lit(rate).alias("sample_rate"))


def resume(units: DataFrame, store: str, checkpoint: str, settings: Settings = Settings(), identity: cache.Identity = cache.Identity(), make: Callable[[DataFrame, int], DataFrame] = mock_segments) -> StreamingQuery:
    """Append the missing segments of every batch to the table at ``store``.

    A batch that runs again after a failure finds what it stored before and adds nothing twice: its rows are written
    under its number, replacing a partial earlier try.
    """
    schema = "key string, samples bigint, sample_rate int"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        asked = cache.requests(rows.withColumn("unit_ord", F.lit(0).cast("long")), settings.max_characters, identity)
        stored = spark.read.schema(f"{schema}, batch bigint").option("ignoreMissingFiles", "true").parquet(store) if _exists(spark, store) else spark.createDataFrame([], f"{schema}, batch bigint")
        before = cache.usable(stored.filter(F.col("batch") != number))
        make(cache.missing(asked, before), settings.sample_rate).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return units.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
