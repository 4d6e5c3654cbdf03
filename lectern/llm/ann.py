"""Approximate nearest neighbours by largest inner product, with a forest of random-projection trees.

A coordinate that makes all norms equal turns the largest inner product into the smallest distance. Trees split rows at
the medians of a bounded sample along directions that are at right angles within a tree, one a level, down to small
leaves. A query takes leaves of all trees from one priority queue, in the order of the squared margins that it would
have to cross, until they hold ``budget`` rows; those rows are ranked by the exact inner product on the vectors as given.

The budget is measured, not guessed: for a few hundred queries, drawn by a hash, the exact neighbours are looked up in a
pass over all rows, each neighbour's place in its query's queue is told, and the budget is where the ``RECALL`` of them
is reached. Where rows have near neighbours it is small and doesn't grow with the table. Where they have none (points
spread evenly over a sphere of 64 dimensions) no tree can tell them apart and it grows; ``exact=True`` takes all leaves
of one tree, which is every row once.

Rows move once for each tree, to the tasks of its branches of about ``BRANCH`` rows; a query moves once for each branch
in which it takes leaves. A branch with more rows, or that more queries take leaves of, is cut into blocks. What scores
less than a query's ``2 k``-th best within the sample can't be among its ``2 k`` best of all, so it doesn't leave a
task; a query that is left with fewer than ``k`` neighbours is searched again without that floor.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part; rows with the query's id are its own; rows that share an id are one candidate, with their best score; ties go
to the smaller id; null ids take no part; other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import session, written

#: Trees; rows of the fitting sample, about; queries that set the budget, about; share of their neighbours to be reached.
TREES, SAMPLE, PROBES, RECALL = 8, 20_000, 256, 0.94
#: Rows that a leaf should have, levels of a tree at most; rows of a branch; rows and queries of a block at most.
LEAF, LEVELS, BRANCH, BLOCK, QUERIES = 64, 16, 2048, 8192, 8192
EVERY, NEAREST = 20, 20


@dataclass
class Forest:
    """``planes[t][level]`` is the unit normal of a level's splits, ``cuts[t][level]`` a threshold for each node; ``norm`` the largest norm."""

    planes: list[np.ndarray]
    cuts: list[list[np.ndarray]]
    norm: float

    @property
    def depth(self) -> int:
        return len(self.cuts[0])

    @property
    def leaves(self) -> int:
        return 2**self.depth

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in each tree, numbered over all trees."""
        x, out = self.lifted(x), []
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts)):
            at, node = np.einsum("nd,ld->nl", x, planes), np.zeros(len(x), np.int64)
            for level, cut in enumerate(cuts):
                node = 2 * node + (at[:, level] > cut[node])
            out.append(t * self.leaves + node)
        return np.stack(out, axis=1)

    def _margins(self, query: np.ndarray) -> list[list[np.ndarray]]:
        x = np.append(query, 0.0)
        return [[planes[level] @ x - cut for level, cut in enumerate(cuts)] for planes, cuts in zip(self.planes, self.cuts)]

    def route(self, query: np.ndarray, sizes: np.ndarray, budget: float) -> np.ndarray:
        """Leaves with rows, in the order of a priority queue that all trees share, until they hold ``budget`` rows."""
        if budget * 16 > sizes.sum():
            return self._all(query, sizes, budget)
        margins = self._margins(query)
        queue, taken, held = [(0.0, t * self.leaves, t, 0, 0) for t in range(len(self.planes))], [], 0
        while queue and held < budget:
            crossed, _, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                margin = margins[t][level][node]
                near = 2 * node + bool(margin > 0)
                level, node = level + 1, near
                first = t * self.leaves + (near ^ 1) * 2 ** (self.depth - level)
                heapq.heappush(queue, (crossed + margin * margin, first, t, level, near ^ 1))
            cell = t * self.leaves + node
            if sizes[cell]:
                taken.append(cell)
                held += sizes[cell]
        return np.array(taken, np.int64)

    def costs(self, query: np.ndarray) -> np.ndarray:
        """What the queue would have added up at every leaf."""
        out = []
        for margins in self._margins(query):
            crossed = np.zeros(1)
            for margin in margins:
                far = crossed + margin * margin
                crossed = np.stack([np.where(margin > 0, far, crossed), np.where(margin > 0, crossed, far)], axis=1).ravel()
            out.append(crossed)
        return np.concatenate(out)

    def _all(self, query: np.ndarray, sizes: np.ndarray, budget: float) -> np.ndarray:
        """The same leaves, where so many are wanted that sorting them all costs less than a queue."""
        some = np.flatnonzero(sizes)
        order = some[np.argsort(self.costs(query)[some], kind="stable")]
        held = np.cumsum(sizes[order])
        return order[: np.searchsorted(held, budget) + 1]


def grow(sample: np.ndarray, norm: float, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 23) -> Forest:
    rng = np.random.default_rng(seed)
    forest = Forest([], [], norm)
    x = forest.lifted(sample)
    levels = int(np.clip(np.ceil(np.log2(max(1, rows) / leaf)), 1, LEVELS))
    width = x.shape[1]
    for _ in range(trees):
        # at right angles as far as there is room, then anew
        planes = np.concatenate([np.linalg.qr(rng.normal(size=(width, width)))[0].T for _ in range(-(-levels // width))])[:levels]
        node, at, cuts = np.zeros(len(x), np.int64), x @ planes.T, []
        for level in range(levels):
            order = np.argsort(node, kind="stable")
            bounds = np.searchsorted(node[order], np.arange(2**level + 1))
            whole = float(np.median(at[:, level]))
            # a node that the sample doesn't reach is cut where all rows are
            cuts.append(np.array([np.median(at[order[i:j], level]) if j > i else whole for i, j in zip(bounds[:-1], bounds[1:])]))
            node = 2 * node + (at[:, level] > cuts[-1][node])
        forest.planes.append(planes)
        forest.cuts.append(cuts)
    return forest


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two tables, one order of summing for every row: equal vectors get equal scores."""
    return np.einsum("nd,nd->n", x, y)


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) the ``k`` best of each query, an id once with its best score, ties to the smaller id."""
    order = np.lexsort((-scores, ids, query))
    query, ids, scores = query[order], ids[order], scores[order]
    once = np.flatnonzero(np.concatenate(([True], (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])))) if len(query) else order
    query, ids, scores = query[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    start = np.concatenate(([0], np.flatnonzero(query[1:] != query[:-1]) + 1)) if len(query) else order
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    return query[rank < k], ids[rank < k], scores[rank < k]


def floors(x: np.ndarray, own: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """A score that ``k`` rows of other ids reach for each of ``x``: its ``k``-th best in a sample with each id once."""
    if len(ids) <= k:
        return np.full(len(x), -np.inf)
    scores = x @ sample.T
    scores[own[:, None] == ids] = -np.inf
    low = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return low - 1e-9 * (1 + np.abs(low))  # sums in another order may differ in the last digits


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(k: int):
    def of(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group["asks"].to_numpy()
        rows, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(rows) and len(queries):
            ids, x, floor = group["vec_id"].to_numpy(), matrix(group["vector"].combine_chunks()), group["floor"].to_numpy()
            leaves = group["leaves"].combine_chunks()
            sizes = leaves.value_lengths().to_numpy(zero_copy_only=False)
            leaf, owner = leaves.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(asks)), sizes)
            mine, theirs = ~asks[owner], asks[owner]
            row_leaf, row, ask_leaf, ask = leaf[mine], owner[mine], leaf[theirs], owner[theirs]
            by_row, by_ask = np.argsort(row_leaf, kind="stable"), np.argsort(ask_leaf, kind="stable")
            row_leaf, row, ask_leaf, ask = row_leaf[by_row], row[by_row], ask_leaf[by_ask], ask[by_ask]
            for here in np.intersect1d(row_leaf, ask_leaf):
                some = row[slice(*np.searchsorted(row_leaf, [here, here + 1]))]
                asking = ask[slice(*np.searchsorted(ask_leaf, [here, here + 1]))]
                for at in range(0, len(some), 1024):
                    part = some[at : at + 1024]
                    q, r = np.nonzero(x[asking] @ x[part].T >= floor[asking][:, None])
                    q, r = asking[q], part[r]
                    apart = ids[q] != ids[r]
                    q, r = q[apart], r[apart]
                    found.append(best(ids[q], ids[r], exact_scores(x[q], x[r]), k))
        columns = best(*(np.concatenate(c) for c in zip(*found)), k)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)

    return of


def probed(rows: DataFrame, probes: tuple[np.ndarray, np.ndarray], forest, k: int) -> list[tuple[int, int, int]]:
    """(probe, leaf, tree) of the exact ``k`` nearest rows of each probe, found in one pass over all rows."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = shared.value
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        cells = {}
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            scores = asked @ x.T
            scores[own[:, None] == ids] = -np.inf
            at = np.argpartition(scores, len(ids) - min(k, len(ids)), axis=1)[:, -min(k, len(ids)) :]
            q, r = np.repeat(np.arange(len(own)), at.shape[1]), at.ravel()
            real = np.isfinite(scores[q, r])
            q, r = q[real], r[real]
            kept = list(best(*(np.concatenate(c) for c in zip(kept, (q, ids[r], scores[q, r]))), k))
            cells |= dict(zip(ids[r].tolist(), forest.value.cells(x[r]).tolist()))
            cells = {i: cells[i] for i in set(kept[1].tolist())}
        lists = pa.array([cells[i] for i in kept[1].tolist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1]), pa.array(kept[2]), lists], ["probe", "vec_id", "score", "cells"])

    order = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    found = rows.select("vec_id", "vector").mapInArrow(run, "probe long, vec_id long, score double, cells array<long>")
    once = found.groupBy("probe", "vec_id").agg(F.max_by("cells", "score").alias("cells"), F.max("score").alias("score"))
    return [(r.probe, r.cells) for r in once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).collect()]  # ``k`` a probe


def budget_for(forest: Forest, sizes: np.ndarray, asked: np.ndarray, answers: list[tuple[int, list[int]]], recall: float) -> float:
    """Rows that leaves taken have to hold so that the ``recall`` of the exact answers are among them."""
    needed, of = [], {}
    for probe, cells in answers:
        of.setdefault(probe, []).append(cells)
    for probe, lists in of.items():
        costs = forest.costs(asked[probe])
        some = np.flatnonzero(sizes)
        order = some[np.argsort(costs[some], kind="stable")]
        before = np.zeros(len(sizes))
        before[order] = np.cumsum(sizes[order])
        needed += [before[cells].min() for cells in lists]
    return float(np.quantile(needed, recall, method="higher")) if needed else 0.0


def nearest(vectors: DataFrame, asked: Column, k: int = NEAREST, trees: int = TREES, recall: float = RECALL, exact: bool = False, leaf: int = LEAF) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found of every row for which ``asked`` holds.

    ``asked`` reads ``vec_id``. What reaches the driver is the sample, one count a leaf or branch, and the answers that
    set the budget. ``exact`` looks at every row.
    """
    spark = session(vectors.sparkSession)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).alias("norm")).orderBy(F.desc("n"), "size").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    size, total, norm = lengths[0]
    rows = written(rows.filter(F.size("vector") == size).withColumn("asks", asked), "vectors")
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32))

    def drawn(df: DataFrame, n: int, of: int) -> tuple[np.ndarray, np.ndarray]:
        """About ``n`` rows of ``df``, never above twice as many: those of the least hashes, each id once."""
        some = df.filter(place < min(1.0, n / max(1, of)) * (1 << 32)).orderBy(place, "vec_id").limit(2 * n).select("vec_id", "vector").toArrow().combine_chunks()
        ids, first = np.unique(some["vec_id"].to_numpy(), return_index=True)
        x = matrix(some["vector"].combine_chunks()) if len(ids) else np.zeros((0, size))
        return ids, x[first]

    sample = drawn(rows, SAMPLE, total)
    forest = spark.sparkContext.broadcast(grow(sample[1] if len(sample[0]) else np.zeros((1, size)), norm, total, 1 if exact else trees, leaf))
    levels, leaves, many = forest.value.depth, forest.value.leaves, len(forest.value.planes)
    low = max(0, levels - max(0, int(np.log2(BRANCH / leaf))))  # the level whose nodes are the branches

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(many * leaves, np.int64)
        for batch in batches:
            counts += np.bincount(forest.value.cells(matrix(batch.column(0))).ravel(), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["cell", "n"])

    sizes = np.zeros(many * leaves, np.int64)
    for cell, n in rows.select("vector").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():  # one row a leaf
        sizes[cell] = n
    asking = rows.filter("asks")
    if exact:
        budget = float(total)
    else:
        probes = drawn(asking, PROBES, asking.count())
        budget = budget_for(forest.value, sizes, probes[1], probed(rows, probes, forest, k), recall)
    shared = spark.sparkContext.broadcast(sample)
    kind = rows.schema["vector"].dataType.simpleString()
    to_branch = lambda cells: cells // leaves * 2**low + (cells % leaves >> levels - low)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every query to the branches in which it takes leaves, with those."""
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            x = matrix(vectors)
            floor = floors(x, ids.to_numpy(), *shared.value, 2 * k)
            at, branches, lists, ends = [], [], [], [0]
            for q in range(len(x)):
                taken = np.sort(forest.value.route(x[q], sizes, budget))
                branch, first = np.unique(to_branch(taken), return_index=True)
                at += [q] * len(branch)
                branches.append(branch)
                lists.append(taken)
                ends += (ends[-1] + np.append(first[1:], len(taken))).tolist()
            at = np.array(at, np.int64)
            flat = np.concatenate([np.empty(0, np.int64), *lists]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, np.int64), *branches]).astype(np.int32)), ids.take(pa.array(at)), vectors.take(pa.array(at)), pa.array(floor[at]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                ["branch", "vec_id", "vector", "floor", "leaves"],
            )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every row to its branch of each tree."""
        for batch in batches:
            cell = forest.value.cells(matrix(batch.column(1)))
            at = np.repeat(np.arange(len(cell)), cell.shape[1])
            flat = cell.ravel()
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(to_branch(flat).astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.zeros(len(at))), one], ["branch", "vec_id", "vector", "floor", "leaves"])

    fields = f"branch int, vec_id long, vector {kind}, floor double, leaves array<int>"
    asks = written(asking.select("vec_id", "vector").mapInArrow(ask, fields), "asks")
    held = np.bincount(to_branch(np.arange(many * leaves)), sizes, minlength=many * 2**low).astype(np.int64)
    dealt = rows.select("vec_id", "vector").mapInArrow(deal, fields)
    columns = ["branch", "block", "query_block", "asks", "vec_id", "vector", "floor", "leaves"]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(asks: DataFrame) -> DataFrame:
        asked_by = {r["branch"]: r["count"] for r in asks.groupBy("branch").count().collect()}  # one row a branch
        cuts = [(b, max(1, -(-int(n) // BLOCK)), max(1, -(-asked_by[b] // QUERIES))) for b, n in enumerate(held) if n and b in asked_by]
        cuts = F.broadcast(spark.createDataFrame(cuts, "branch int, blocks int, query_blocks int"))
        hashed = F.xxhash64("vec_id", F.lit(1))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = dealt.join(cuts, "branch").withColumn("block", F.pmod(hashed, "blocks").cast("int")).withColumn("query_block", every("query_blocks")).withColumn("asks", F.lit(False))
        theirs = asks.join(cuts, "branch").withColumn("query_block", F.pmod(hashed, "query_blocks").cast("int")).withColumn("block", every("blocks")).withColumn("asks", F.lit(True))
        met = mine.select(*columns).unionByName(theirs.select(*columns)).groupBy("branch", "block", "query_block").applyInArrow(_search(k), "query_id long, vec_id long, score double")
        once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = written(ranked(asks), "found")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asks.filter(F.col("floor") > float("-inf")).join(full, "vec_id", "left_anti")
    if short.isEmpty():
        return found
    short = written(short.withColumn("floor", F.lit(float("-inf"))), "short")
    again = ranked(short)
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again)
