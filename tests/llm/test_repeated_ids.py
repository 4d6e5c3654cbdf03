"""An id that fills a leaf block's places leaves room for the block's other neighbours."""

import numpy as np
import pyarrow as pa


def test_rows_of_one_id_take_one_place():
    from lectern.llm.ann import _search

    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 8))
    ids = np.concatenate((np.arange(300), np.full(41, 7), [9]))
    x = np.concatenate((x, np.tile(3 * x[0], (41, 1)), [2 * x[0]]))  # 7 is the nearest many times, 9 has two vectors
    order = rng.permutation(len(ids))
    ids, x = ids[order], x[order]
    q = np.flatnonzero(ids == 0)[0]
    rows = [np.concatenate((ids, [0])), np.concatenate((x, [x[q]])), np.concatenate((np.zeros(len(ids), bool), [True]))]
    more = lambda n: {"floor": pa.array([-np.inf] * n), "leaves": pa.array([[5]] * n, pa.list_(pa.int32()))}
    got = _search(20)(pa.table({"vec_id": pa.array(rows[0]), "vector": pa.array(rows[1].tolist()), "asks": pa.array(rows[2])} | more(len(rows[0])))).to_pydict()
    score = {}
    for i, s in zip(ids.tolist(), np.einsum("cd,d->c", x, x[q]).tolist()):
        if i != 0:
            score[i] = max(s, score.get(i, -np.inf))
    want = sorted(score, key=lambda i: (-score[i], i))[:20]
    assert got["vec_id"] == want and np.allclose(got["score"], [score[i] for i in want]) and want[:2] == [7, 9]
    alone = {"vec_id": [0], "vector": [x[q].tolist()], "asks": [True]}
    assert _search(20)(pa.table(alone | more(1))).num_rows == 0


def test_queue_and_sorted_leaves_agree():
    from lectern.llm.ann import grow

    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 12)) * rng.uniform(0.5, 2, (4000, 1))
    forest = grow(x[:1500], float(np.linalg.norm(x, axis=1).max()), len(x), trees=3, leaf=16)
    cells = forest.cells(x)
    sizes = np.bincount(cells.ravel(), minlength=3 * forest.leaves)
    for q in x[:20]:
        for budget in (1, 40, 500):
            queue, order = forest.route(q, sizes, budget), forest._all(q, sizes, budget)
            assert queue.tolist() == order.tolist() and sizes[queue].sum() >= budget > sizes[queue[:-1]].sum()
        assert set(forest.route(q, sizes, sizes.sum())) == set(np.flatnonzero(sizes))


def test_budget_follows_the_data_and_exact_looks_at_every_row(spark, monkeypatch):
    """Clustered vectors need few rows however many there are; those without neighbours need a large share."""
    from pyspark.sql import functions as F

    from lectern.llm import ann

    taken, measure = [], ann.budget_for
    monkeypatch.setattr(ann, "budget_for", lambda *a: taken.append(measure(*a)) or taken[-1])
    rng = np.random.default_rng(4)

    def recall(x, **how):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
        got = ann.nearest(df, F.col("vec_id") % 20 == 0, **how).toPandas().groupby("query_id")["vec_id"].apply(set)
        hits = 0
        for q, found in got.items():
            s = x @ x[q]
            s[q] = -np.inf
            assert len(found) == 20
            hits += len(found & set(np.lexsort((np.arange(len(s)), -s))[:20].tolist()))
        return hits / 20 / len(got)

    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    clustered = lambda n: unit(np.repeat(unit(rng.normal(size=(n // 40, 32))), 40, axis=0) + 0.05 * rng.normal(size=(n, 32)))
    assert recall(clustered(2000)) >= 0.9 and recall(clustered(8000)) >= 0.9
    assert taken[1] < 0.2 * 8000 and taken[1] < 2 * taken[0] + 512
    even = unit(rng.normal(size=(2000, 32)))
    assert recall(even) >= 0.9 and taken[2] > 0.3 * 2000 and recall(even, exact=True) == 1.0
