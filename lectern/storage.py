"""Written tables that cut a lineage: in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        found = sc.getCheckpointDir()
    return f"{found.rstrip('/')}/lectern-{sc.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and gives the planner true sizes."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, by: str) -> tuple[DataFrame, int]:
    """``df`` dealt by a key once, so that windows, groups and joins by it, also through ``in_buckets``, move no row again; and the number of parts.

    There are as many as the session asks for, or as the files have splits, if those are more. The session is told that
    joins by the key and further columns keep the deal too.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df._jdf.rdd().getNumPartitions())
    return df.repartition(parts, by), parts


def in_buckets(df: DataFrame, label: str, parts: int, by: str = "book_id") -> DataFrame:
    """Like ``written``, as a table that Spark knows to be dealt by ``by``; ``df`` should come from rows ``dealt`` alike.

    A table of the session's catalog whose files lie in the shared folder; ``purge`` drops it.
    """
    spark = df.sparkSession
    name = f"lectern_{label}_{uuid.uuid4().hex}"
    df.write.option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(parts, by).saveAsTable(name)
    return spark.table(name)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if the files have fewer splits than that; large inputs are left as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


def purge(spark: SparkSession) -> None:
    """Delete the tables written so far. Call it when no result that reads them is needed any more."""
    for table in spark.catalog.listTables(pattern="lectern_*"):
        if re.fullmatch(r"lectern_[a-z]+_[0-9a-f]{32}", table.name):
            spark.sql(f"drop table {table.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
