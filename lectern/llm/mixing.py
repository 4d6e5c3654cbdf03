"""Mixing sources to target weights, with DataFrame operations only.

The words of each source are summed; targets share the total by weight, and a target stops at ``CAP`` times its
source's words, the excess going to the others by weight. A source's rate is its target over its words; a document
is taken ``floor(rate)`` times and once more if its seeded hash falls below the fraction. The hash reads the id, the
text and, of rows alike in both, the occurrence, so each row has a draw of its own.

The level at which all targets add up to the total is a maximum over the sources in the order of words by weight:
of the first k at their cap, (total - CAP * their words) / weight of the rest. Exact integers meet one division, so
reruns and other engines agree. Sources are ranked and summed up along an order in two steps (``along``), ranges first,
so there may be as many sources as documents.

Defined results: a null text has size 0; a null source is a source of its own, last; rows of a source without words
have target 0 and take nothing; rows alike in id and text have the draws of occurrences 1, 2, ..., of which it doesn't
matter which has which; null ids are one id; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, joined_evenly, written

#: Weights of the sources in the order of their names, repeating; times a source's words that a target may reach.
WEIGHTS, CAP, SEED = (5, 2, 1), 3, 17
#: Sources up to which their table is broadcast; beyond, the planner chooses.
BROADCAST_ROWS = 10_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    """What a draw reads of a text."""
    return F.coalesce(F.md5(text.cast("binary")), F.lit("null"))


def draw(seed: int = SEED) -> Column:
    """A number in [0, 2**32) from the seed, the id, the text's digest and the occurrence."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "digest", F.col("occurrence").cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def along(rows: DataFrame, by: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``rows`` with ``before_<name>``: each sum over all rows that come before in the order ``by``, which is total.

    Ranges of the order are summed alone, the ranges' sums meet in one small window, and a range is summed along within.
    """
    pieces = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.repartitionByRange(pieces, *by).withColumn("__piece", F.spark_partition_id()), label)
    totals = ranged.groupBy("__piece").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    begins = totals.select("__piece", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums])
    within = Window.partitionBy("__piece").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    met = ranged.join(F.broadcast(begins), "__piece")
    return met.select(*rows.columns, *[(F.col(f"__{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"before_{n}") for n, c in sums.items()])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target, documents`` for each source of ``sizes(source, size)``, summed before any shuffle."""
    summed = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    name = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("before_place") % len(weights) + 1).cast("int")).cast("long")
    weighed = along(summed, name, {"place": F.lit(1).cast("long")}, "sources").select("source", "source_size", "documents", weight.alias("weight"))
    # integers order the ratios exactly: words a / weight a before words b / weight b, over the weights' product
    scale = 1
    for w in set(weights):
        scale *= w
    ratio = [(F.col("source_size") * (F.lit(scale) / F.col("weight")).cast("long")).asc(), *name]
    parts = along(weighed, ratio, {"size": F.col("source_size"), "weight": F.col("weight")}, "weighed")
    whole = parts.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"))
    spare = parts.crossJoin(F.broadcast(whole.select(F.col("size").alias("all_size"), F.col("weight").alias("all_weight"))))  # one row
    spare = spare.select((F.col("all_size") - cap * F.col("before_size")).alias("left"), (F.col("all_weight") - F.col("before_weight")).alias("shared"))
    best = spare.agg(F.max(F.struct((F.col("left") / F.col("shared")).alias("level"), "left", "shared")).alias("best"))
    level = F.least((F.col("best.left") * F.col("weight")) / F.col("best.shared"), (cap * F.col("source_size")).cast("double"))
    return parts.crossJoin(F.broadcast(best)).select("source", "source_size", level.alias("target"), "documents")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, digest, tie, ...)`` with ``occurrence``: from 1 up among rows alike in id and digest, in any order.

    Only rows that have a double are ranked, each partition's doubles alone; the counts of the partitions give where
    each goes on. So a text that a third of all rows repeat under one id fills no task.
    """
    key = ["doc_id", "digest"]
    # nulls meet nulls in groups, so joins use an id that is never null
    piece = F.shiftright("tie", 33)
    some = rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").select(F.xxhash64(F.col("doc_id").isNull(), *key).alias("group"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("digest").alias("of"), F.col("n"))
    mine = rows.withColumn("group", F.xxhash64(F.col("doc_id").isNull(), *key)).withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("of", F.col("digest"))
    some = written(some, "doubles")
    total = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return rows.withColumn("occurrence", F.lit(1).cast("long"))
    names = ["group", "id", "of"]
    double = written(joined_evenly(mine, some, names, "n", total), "double").withColumn("piece", piece)
    inside = double.withColumn("inside", F.row_number().over(Window.partitionBy(*names, "piece").orderBy("tie")))
    counts = double.groupBy(*names, "piece").agg(F.count("*").alias("n"))  # one row a partition of the input, at most, of a group
    begins = counts.select(*names, "piece", F.coalesce(F.sum("n").over(Window.partitionBy(*names).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    placed = inside.join(begins, [*names, "piece"]).withColumn("occurrence", F.col("begin") + F.col("inside"))
    single = mine.join(some, names, "left_anti").withColumn("occurrence", F.lit(1).cast("long"))
    return single.select(*rows.columns, "occurrence").unionByName(placed.select(*rows.columns, "occurrence"))


def rated(rows: DataFrame, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``rows``, with ``source`` and ``size``, and ``source_size``, ``target`` and ``rate`` of their source."""
    aims = written(targets(rows.select("source", "size"), weights, cap), "targets")
    named = aims.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("aim"), "source_size", "target", "documents")
    keyed = rows.withColumn("no_source", F.col("source").isNull()).withColumn("aim", F.coalesce("source", F.lit("")))
    if aims.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = keyed.join(F.broadcast(named.drop("documents")), ["no_source", "aim"])
    else:
        met = joined_evenly(keyed, named, ["no_source", "aim"], "documents", named.agg(F.sum("documents")).first()[0])
    return met.drop("no_source", "aim").withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0))


def copies(seed: int = SEED) -> Column:
    """How often a row with a ``rate`` and what ``draw`` reads is taken."""
    extra = draw(seed) < F.floor((F.col("rate") - F.floor("rate")) * F.lit(2**32))
    return F.floor("rate") + extra.cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(text).alias("size"), text_digest(text).alias("digest"))
    return written(columns.withColumn("tie", F.monotonically_increasing_id()), "sizes")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them.

    Each row meets its source's rate, and only rows that have a double under their id meet their occurrence. Texts move
    for those, and for all rows only if the names of the doubles are too many for the planner to broadcast.
    """
    # names of their own, as the documents may have columns of any name
    text = F.col("text").cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(text).alias("size"), text_digest(text).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    taken = rated(numbered(rows), cap, weights).select("row", copies(seed).alias("n")).filter("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every row. Texts are read once, for their sizes and digests."""
    counted = rated(numbered(_sized(docs)), cap, weights).withColumn("copies", copies(seed))
    return counted.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
