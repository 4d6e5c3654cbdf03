"""SimHash near-duplicate classes with a Gray-order hierarchical index.

Fingerprints are made in one pass over whole texts and equal ones collapse. The distinct codes are sorted by Gray rank
and cut into runs; codes that are near in that order share bits, so each run has a mask of the bits that all its codes
share, and their pattern. Upper nodes factor out what eight nodes below them share, up to the top; this shared tree of
runs is all that is broadcast, and there are at most ``RUNS`` runs however many codes there are. Every code walks down
the tree with the differences that it has added up, leaves a whole node when they pass the radius, and enters the runs
that are left, later ones than its own, so each pair meets once. In a run the tree goes on down to leaves of ``LEAF``
codes. A run that many codes enter is searched in several tasks, each with the run and some of the codes. A task
returns a star of links for each class it sees, never pairs; ``components`` joins the stars.

Defined results: a null text or one without words has fingerprint zero, and such rows link like any others; a text
with fewer words than a shingle is one shingle; repeated rows get equal results; rows with a null id are linked but
never name a class, so a class of null ids alone has a null component; other columns are left out; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import decoded, joined_evenly, session, written
from .components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Codes of a lowest node, children of an upper one, queries searched together at most, and codes that they all may meet.
LEAF, FANOUT, QUERIES, TOGETHER = 16, 8, 1024, 1 << 21
#: Shingles whose bits are counted at a time.
STRETCH = 1 << 16
#: Runs, however few codes there are, so that a code enters as many at every size; the codes of a run at most, beyond
#: which there are more runs; the most runs, beyond which they grow again; codes that one task searches a run for.
RUNS, RUN, MOST, VISITS = 256, 1 << 20, 1 << 16, 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles: a bit is set if it is set in over half of their hashes."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int.from_bytes(xxh64_digest(joined, SEED), "big")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, STRETCH):
        hashes = b"".join([xxh64_digest(joined[i:j], SEED) for i, j in zip(starts[at : at + STRETCH], stops[at : at + STRETCH])])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: str) -> DataFrame:
    """``doc_id``, long columns ``more`` as they are, and ``code`` (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t, shingle) for t in decoded(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(codes)], ["doc_id", *more, "code"])

    session(docs.sparkSession)
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *more)
    return columns.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", *more, "code")))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence: the prefix parities of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _shared(mask: np.ndarray, pattern: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every ``run`` neighbouring nodes, the bits that they share and their pattern."""
    at = np.arange(0, len(mask), run)
    first = np.repeat(pattern[at], run)[: len(mask)]
    both = np.bitwise_and.reduceat(mask & ~(pattern ^ first), at)
    return both, pattern[at] & both


def steps(n: int, against: int) -> Iterator[np.ndarray]:
    """Places up to ``n`` in pieces such that meeting all of ``against`` takes a bounded space."""
    size = max(1, min(QUERIES, TOGETHER // max(1, against)))
    for at in range(0, n, size):
        yield np.arange(at, min(n, at + size))


class GrayTree:
    """A hierarchy over nodes in Gray order, each a mask and a pattern. ``levels`` goes from the top to the given nodes."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray):
        levels = [(mask, pattern)]
        while len(levels[0][0]) > FANOUT:
            levels.insert(0, _shared(*levels[0], FANOUT))
        above = np.zeros(len(levels[0][0]), np.uint64)
        self.levels = []
        for k, (mask, pattern) in enumerate(levels):
            self.levels.append((mask & ~above, pattern))  # what an upper node has counted isn't counted again
            if k + 1 < len(levels):
                above = np.repeat(mask, FANOUT)[: len(levels[k + 1][0])]

    def entered(self, codes: np.ndarray, radius: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of ``codes``, the lowest nodes later than ``after`` that they enter, and the differences up to there."""
        top = len(self.levels[0][0])
        query = np.repeat(np.arange(len(codes)), top)
        node, apart = np.tile(np.arange(top), len(codes)), np.zeros(len(query), np.int64)
        for k, (mask, pattern) in enumerate(self.levels):
            reach = FANOUT ** (len(self.levels) - 1 - k)
            later = (node + 1) * reach > after[query] + 1
            query, node, apart = query[later], node[later], apart[later]
            apart = apart + np.bitwise_count((codes[query] ^ pattern[node]) & mask[node])
            keep = apart <= radius
            query, node, apart = query[keep], node[keep], apart[keep]
            if k + 1 < len(self.levels):
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                query, apart = np.repeat(query, FANOUT), np.repeat(apart, FANOUT)
                real = node < len(self.levels[k + 1][0])
                query, node, apart = query[real], node[real], apart[real]
        return query, node, apart


class GrayIndex:
    """A tree over leaves of ``LEAF`` distinct codes in Gray order."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        mask, pattern = _shared(np.full(len(codes), ~np.uint64(0)), self.codes, LEAF)
        self.tree = GrayTree(mask, pattern)
        self.rest = ~np.repeat(mask, LEAF)[: len(codes)]

    def near(self, codes: np.ndarray, radius: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``codes`` and places in Gray order, later than ``after``, of all pairs within the radius."""
        query, leaf, apart = self.tree.entered(codes, radius, after // LEAF - 1)
        at = (leaf[:, None] * LEAF + np.arange(LEAF)).ravel()
        query, apart = np.repeat(query, LEAF), np.repeat(apart, LEAF)
        keep = (at < len(self.codes)) & (at > after[query])
        query, at, apart = query[keep], at[keep], apart[keep]
        near = apart + np.bitwise_count((codes[query] ^ self.codes[at]) & self.rest[at]) <= radius
        return query[near], at[near]

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places, in the order given to the index, of all pairs of its own codes within ``radius``, each once."""
        for some in steps(len(self.codes), len(self.codes)):
            query, found = self.near(self.codes[some], radius, some)
            yield self.order[some[query]], self.order[found]

    def visits(self, codes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in ``codes``, and in the order given to the index, of all pairs within ``radius``."""
        for some in steps(len(codes), len(self.codes)):
            query, found = self.near(codes[some], radius, np.full(len(some), -1))
            yield some[query], self.order[found]


def least_labels(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place of each place's class."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            label = label[label]
            if (label == before).all() and (label[i] == label[j]).all():
                break
    while (label[label] != label).any():
        label = label[label]
    return label


def rank_column(code: Column) -> Column:
    """``gray_rank`` as a column, with the sign bit turned so that signed order is the ranks' order."""
    rank = code
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _runs(size: int):
    """Cut each sorted partition into runs of ``size`` codes, with the mask of the bits that a run's codes share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held, many = TaskContext.get().partitionId(), 0, [], 0

        def close(codes: np.ndarray) -> pa.RecordBatch:
            first = codes[0]
            mask = ~np.bitwise_or.reduce(codes ^ first)
            row = [part, serial, int(mask.view(np.int64)), int((first & mask).view(np.int64)), codes.view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["part", "serial", "mask", "pattern", "codes"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            many += len(held[-1])
            while many >= size:
                every = np.concatenate(held)
                yield close(every[:size])
                held, many, serial = [every[size:]], many - size, serial + 1
        if many:
            yield close(np.concatenate(held))

    return run


def _star(nodes: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each of the sorted ``nodes`` that isn't the smallest of its class, after that smallest one."""
    label = least_labels(len(nodes), pairs)
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[other]], nodes[other]


def _searched(radius: int):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(group: pa.Table) -> pa.Table:
        kinds, codes = group["own"].to_numpy(), group["code"].to_numpy().view(np.uint64)
        members, guests = codes[kinds], codes[~kinds]
        nodes = np.unique(codes.view(np.int64))
        index = GrayIndex(members)
        own, other = (np.searchsorted(nodes, x.view(np.int64)) for x in (members, guests))

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if group["first"][0].as_py():  # of the tasks of a run, one compares its own codes
                for i, j in index.pairs(radius):
                    yield own[i], own[j]
            for i, j in index.visits(guests, radius):
                yield other[i], own[j]

        return pa.Table.from_arrays([pa.array(x) for x in _star(nodes, pairs())], schema=out)

    return of


def links(codes: DataFrame, radius: int = RADIUS, runs: int = RUNS, run: int = RUN, most: int = MOST, visits: int = VISITS) -> DataFrame:
    """``a, b``: links that join exactly the distinct ``code`` values connected by steps within ``radius``."""
    spark = session(codes.sparkSession)
    codes = codes.select("code")
    total = codes.count()
    size = max(LEAF, min(run, -(-total // runs)), -(-total // most))
    pieces = max(1, -(-total // (16 * size)))
    ranged = codes.select("code", rank_column(F.col("code")).alias("rank")).repartitionByRange(pieces, "rank").sortWithinPartitions("rank").select("code")
    cut = written(ranged.mapInArrow(_runs(size), "part int, serial int, mask long, pattern long, codes array<long>"), "runs")
    nodes = sorted(tuple(r) for r in cut.select("part", "serial", "mask", "pattern").collect())  # at most ``most`` and one a partition
    if not nodes:
        return spark.createDataFrame([], "a long, b long")
    number = {(p, s): k for k, (p, s, *_) in enumerate(nodes)}
    mask, pattern = (np.array([n[k] for n in nodes], np.int64).view(np.uint64) for k in (2, 3))
    tree = spark.sparkContext.broadcast((GrayTree(mask, pattern), number))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, place = tree.value
        for batch in batches:
            for part, serial, list_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                codes = list_.values.to_numpy(zero_copy_only=False).view(np.uint64)
                for some in steps(len(codes), len(place)):
                    query, node, _ = shared.entered(codes[some], radius, np.full(len(some), place[part, serial]))
                    yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(codes[some[query]].view(np.int64))], ["run", "code"])

    entered = written(cut.select("part", "serial", "codes").mapInArrow(enter, "run int, code long"), "entered")
    asked = {r["run"]: r["count"] for r in entered.groupBy("run").count().collect()}  # one row a run
    shares = F.broadcast(spark.createDataFrame([(*key, k, max(1, -(-asked.get(k, 0) // visits))) for key, k in number.items()], "part int, serial int, run int, shares int"))
    members = cut.join(shares, ["part", "serial"]).select("run", "codes", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).select("run", "share", F.explode("codes").alias("code"), F.lit(True).alias("own"))
    guests = entered.join(shares.select("run", "shares"), "run").select("run", F.pmod(F.xxhash64("code"), F.col("shares")).cast("int").alias("share"), "code", F.lit(False).alias("own"))
    met = members.unionByName(guests).withColumn("first", F.col("share") == 0)
    return met.groupBy("run", "share").applyInArrow(_searched(radius), "a long, b long")


def classes(codes: DataFrame, radius: int = RADIUS, **sizes: int) -> DataFrame:
    """``code, root`` of the distinct ``code`` column that differ from the root of their class."""
    return components(links(codes, radius, **sizes)).select(F.col("node").alias("code"), "root")


def one_of_each(docs: DataFrame, made: DataFrame, found: DataFrame, code: Column) -> DataFrame:
    """One row of ``docs`` of each class. ``made`` has ``doc_id, code, rows``, ``found`` ``code, root``; ``code`` reads ``text``.

    Rows alike in id and code, of which there may be very many, are one row of ``made``; they meet the chosen ones
    without a shuffle if they are hot, and merge before they move.
    """
    key = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)).alias("id"), "code", "rows")
    # the first of each code is told before roots are looked up, so a code's copies don't meet in a join
    least = made.groupBy("code").agg(F.min(key).alias("k"))
    chosen = least.join(found, "code", "left").groupBy(F.coalesce("root", "code").alias("root")).agg(F.min("k").alias("k"))
    chosen = written(chosen.select(F.col("k.col1").alias("no_id"), F.col("k.id").alias("id"), F.col("k.code").alias("code"), F.col("k.rows").alias("rows")), "chosen")
    # names of their own, as the documents may have columns of any name
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), code.alias("code"))
    total = chosen.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    met = joined_evenly(rows, chosen.withColumn("copies", F.col("rows")), ["no_id", "id", "code"], "copies", total)
    single = met.filter("rows = 1").select("row")
    repeated = met.filter("rows > 1").groupBy("no_id", "id", "code").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")


def deduplicated(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id, null ids last, then of the smallest text hash.

    Every text is fingerprinted once; rows are found again by id and hash of the text, and move once.
    """
    key = text_key()
    made = written(fingerprints(docs.select("doc_id", "text", key.alias("__key")), shingle, "__key").withColumnRenamed("__key", "key"), "fingerprints")
    keys = written(made.groupBy("key").agg(F.min("code").alias("code")), "keys")
    codes = written(keys.groupBy("code").agg(F.count("*").alias("texts")), "codes")
    rooted = codes.join(classes(codes, radius), "code", "left").select("code", "texts", F.coalesce("root", "code").alias("root"))
    found = joined_evenly(keys, written(rooted, "rooted"), ["code"], "texts", keys.count()).select(F.col("key").alias("code"), "root")
    return one_of_each(docs, made.groupBy("doc_id", F.col("key").alias("code")).agg(F.count("*").alias("rows")), written(found, "classes"), key)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Texts are read once and never shuffled; what moves is 16 bytes a row, the distinct codes with the runs that they
    enter, and the links. No step gathers a class or the codes in one place.
    """
    made = written(fingerprints(docs, shingle), "fingerprints")
    codes = written(made.groupBy("code").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "codes")
    rooted = codes.join(classes(codes, radius), "code", "left").select("code", F.coalesce("root", "code").alias("root"), "first", "copies")
    rooted = written(rooted, "rooted")
    named = written(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("codes")), "named")
    sums = rooted.agg(F.count("*").alias("codes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    labels = written(joined_evenly(rooted, named, ["root"], "codes", sums.codes).select("code", "copies", "component_id"), "labels")
    return joined_evenly(made, labels, ["code"], "copies", sums.rows).select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
