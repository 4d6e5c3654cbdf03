"""Files made of rows: whole or not at all, by the executors that hold the rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PLAIN = r"^(?!\.{1,2}(?:/|\z))[^/\\\x00]+(?:/(?!\.{1,2}(?:/|\z))[^/\\\x00]+)*\z"


def safe_name(c: str | Column) -> Column:
    """Whether a relative name stays below its folder."""
    return (F.col(c) if isinstance(c, str) else c).rlike(_PLAIN)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write ``files(name, content)``, texts or bytes, below ``folder``, which all executors share; ``name, bytes`` of what was written.

    Every file is written beside its place and renamed, so a reader sees the old or the new one, and a task that runs
    again leaves the same. Unsafe names and null contents raise an error. Nothing is written before the result is read.
    """
    content = F.col("content")
    as_bytes = F.encode(content, "UTF-8") if dict(files.dtypes)["content"] == "string" else content
    refused = F.raise_error(F.concat(F.lit("not a plain file name or no content: "), F.coalesce("name", F.lit("null"))))
    checked = files.select("name", F.when(safe_name("name") & content.isNotNull(), as_bytes).otherwise(refused.cast("binary")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for batch in batches:
            sizes = []
            for name, data in zip(*(c.to_pylist() for c in batch.columns)):
                path = f"{root.rstrip('/')}/{name}"
                parent, _, own = path.rpartition("/")
                where.create_dir(parent, recursive=True)
                beside = f"{parent}/.{own}.{uuid.uuid4().hex}"
                with where.open_output_stream(beside) as out:
                    out.write(data)
                where.move(beside, path)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return checked.mapInArrow(run, "name string, bytes bigint")


def joined_lines(rows: DataFrame, by: str, order: str, line: str) -> DataFrame:
    """``by, content``: the lines of each key, in order, each with a line end."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line])
    return rows.groupBy(by).agg(F.concat(F.array_join(listed, "\n"), F.lit("\n")).alias("content"))
