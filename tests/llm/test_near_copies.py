"""The pipeline's near-duplicate stage against all pairs, with planted edited copies."""

import random

import numpy as np
import pytest

from .conftest import frame, words


def alike(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])


def edited(rng, text, share):
    return " ".join(words(rng, 1) + "x" if rng.random() < share else w for w in text.split())


@pytest.mark.parametrize("limit", [None, 6])
def test_stage_drops_edited_copies(spark, tmp_path, corpus, limit):
    import corpus_pipeline
    from lectern.llm.near_copies import without_near_copies

    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = words(rng, rng.randint(100, 400))
        texts += [base, edited(rng, base, 0.01), edited(rng, base, 0.02), edited(rng, base, 0.08)]
    shared = words(rng, 60)
    texts += [shared + " " + words(rng, 40) for _ in range(20)]  # alike, but below 0.8
    rows = corpus + [(1000 + k, t, "en", "a") for k, t in enumerate(texts)]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    near = [(i, j) for j in range(len(rows)) for i in range(j) if alike(rows[i][1], rows[j][1])]
    assert sum(rows[i][1] != rows[j][1] for i, j in near) > 60
    for i, j in near:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    least = {}
    for k, (i, *_) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    want = sorted((min((i for i in ids if i is not None), default=None) for ids in least.values()), key=repr)
    docs = frame(spark, rows)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)) if limit is None else without_near_copies(docs, limit)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_signatures_of_equal_sets_and_an_empty_table(none):
    from lectern.llm.near_copies import alike, shingles, signature, without_near_copies

    x, y = shingles(b"One two  three"), shingles(b"one two three")
    assert np.array_equal(signature(x), signature(y)) and alike(x, y) and without_near_copies(none).count() == 0
    rng, agree = np.random.default_rng(1), []
    for _ in range(200):  # a similarity of just 0.8
        both = np.unique(rng.integers(0, 2**32, 450, np.uint32))[:400]
        rest = np.setdiff1d(np.unique(rng.integers(0, 2**32, 120, np.uint32)), both)[:100]
        a, b = np.sort(np.concatenate((both, rest[:50]))), np.sort(np.concatenate((both, rest[50:])))
        assert alike(a, b) and not alike(a, both[:-50])
        agree.append((signature(a) == signature(b)).sum())
    assert min(agree) >= 80 and abs(np.mean(agree) - 0.8 * 128) < 2
