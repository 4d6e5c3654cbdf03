"""Classes of texts that are linked by their SimHash codes or by their sets of five-word shingles.

The Gray-order tree of ``simhash_gray`` finds all codes within its radius, and texts of such codes are linked, as there.
A SimHash radius that holds all pairs of a Jaccard similarity of 0.8 or more is about 22 of 64 bits, too wide for the
tree to leave any node, so these are linked too, on their own sets. Their candidates come from MinHash bands: ``BANDS`` keys of ``ROWS`` least hashes each, of which a pair of similarity s shares
one with probability 1 - (1 - s**ROWS)**BANDS, 0.99999995 at 0.8. All least hashes of a text are its signature; pairs
that agree in fewer than ``AGREE`` of them (five standard deviations below 0.8) are passed over. Every other candidate
is confirmed on the whole sets:

1. Each member of a band's group against the group's hub, the text whose own groups are the largest, which is the one
   that copies were made from if there is such a text. This joins large classes at a linear cost.
2. In groups that still hold texts of several classes, pairs of different classes, each in the first band that it
   shares. Pairs stay inside the task that looks at them: it first names the texts that have a candidate, then gets
   the sets of those and returns links that span its classes. Groups above ``LIMIT`` texts go chunk against chunk.

Defined results: words and blanks are those of ``simhash_gray``; a text with fewer words than a shingle is one shingle;
texts without words are one class; null texts are empty; null ids come last when a class's row is chosen; repeated rows
are one class, from which one row stays; columns of any name are kept; an empty table gives an empty one. Texts are
told apart by 64-bit hashes, a text's shingles by 32-bit ones: among 10,000 shingles one in 80 texts has a collision,
which shifts its similarities by 1/10,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, decoded, joined_evenly, mixed, session, written
from .components import components
from .simhash_gray import classes, fingerprint, one_of_each, text_key

SHINGLE, LIKE, BANDS, ROWS, AGREE = 5, 0.8, 32, 4, 80
#: Texts of a group that one task looks at together; pairs that share a hub and are confirmed together.
LIMIT, TOGETHER = 1024, 512
#: Shingles whose hashes are compared at a time.
STRETCH = 1 << 12
_rng = np.random.default_rng(5)
FLIPS, FACTORS = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32), _rng.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
_known = WordHashes()


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the text's word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint32)
    h = _known.of(words)
    n = max(1, len(h) - SHINGLE + 1)
    total = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(len(h), SHINGLE)):
        total = mixed(total ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique((mixed(total) >> np.uint64(32)).astype(np.uint32))


def signature(found: np.ndarray) -> np.ndarray:
    """Of each hash function, 16 bits of the least value over a set of shingles."""
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(found), STRETCH):
        np.minimum(least, ((found[at : at + STRETCH, None] ^ FLIPS) * FACTORS).min(axis=0), out=least)
    return (mixed(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")  # least values have few high bits set


def _sketches(texts: DataFrame) -> DataFrame:
    """``doc_id, key, code, sig, shingles`` of every row; ``code`` is that of ``simhash_gray``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, sets = [], []
            for t in decoded(batch.column(2)):
                codes.append(fingerprint(t))
                sets.append(shingles(t))
            code = pa.array(np.array(codes, np.uint64).view(np.int64))
            packed = [pa.array(x, pa.binary()) for x in ([signature(s).tobytes() for s in sets], [s.tobytes() for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, *packed], ["doc_id", "key", "code", "sig", "shingles"])

    return texts.mapInArrow(run, "doc_id long, key long, code long, sig binary, shingles binary")


def _code_links(texts: DataFrame) -> DataFrame:
    """``a, b``: links of the texts of each class of SimHash codes, found by the Gray-order tree, to its least key."""
    codes = written(texts.groupBy("code").agg(F.min("key").alias("least"), F.count("*").alias("copies")), "codes")
    rooted = written(codes.join(classes(codes), "code", "left").withColumn("root", F.coalesce("root", "code")), "coded")
    hubs = written(rooted.groupBy("root").agg(F.min("least").alias("a"), F.count("*").alias("codes")), "coded")
    sums = rooted.agg(F.count("*").alias("codes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("texts")).first()
    named = written(joined_evenly(rooted, hubs, ["root"], "codes", sums.codes).select("code", "copies", "a"), "coded")
    return joined_evenly(texts.select("key", "code"), named, ["code"], "copies", sums.texts).filter("key <> a").select("a", F.col("key").alias("b"))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets have a similarity of ``LIKE`` or more."""
    small, large = sorted((len(x), len(y)))
    if small < LIKE * large:
        return False
    merged = np.concatenate((x, y))
    merged.sort()
    both = int((merged[1:] == merged[:-1]).sum())
    return both >= LIKE * (len(x) + len(y) - both)


def _sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) if x else np.empty(0, np.uint32) for x in column.to_pylist()]


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BANDS * ROWS)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _agreeing(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``a, b`` of a written table whose signatures may belong to texts that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = (_signatures(batch.column(2)) == _signatures(batch.column(3))).sum(axis=1) >= AGREE
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])

    hubs = pairs.groupBy("a").agg(F.count("*").alias("n")).join(texts.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a")
    met = joined_evenly(pairs, written(hubs, "hubs"), ["a"], "n", pairs.count())
    return met.join(texts.select(F.col("key").alias("b"), F.col("sig").alias("sig_b")), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``a, b`` of a written table whose sets are alike. A hub's set goes once to each ``TOGETHER`` of its pairs."""

    def of(group: pa.Table) -> pa.Table:
        hub, sets = group["hub"].to_numpy(), _sets(group["shingles"])
        own = next(s for s, h in zip(sets, hub) if h)
        keep = np.array([not h and alike(own, s) for s, h in zip(sets, hub)], bool)
        return pa.Table.from_arrays([group[c].filter(pa.array(keep)).combine_chunks() for c in ("a", "b")], schema=_LINKS)

    counts = written(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / TOGETHER)), "counts")
    dealt = joined_evenly(pairs, counts, ["a"], "n", pairs.count()).withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    sets = lambda c: texts.select(F.col("key").alias(c), "shingles")
    members = dealt.join(sets("b"), "b").select("a", "part", "b", "shingles", F.lit(False).alias("hub"))
    hubs = counts.join(sets("a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("b"), "shingles", F.lit(True).alias("hub"))
    return members.unionByName(hubs).groupBy("a", "part").applyInArrow(of, "a long, b long")


def _candidates(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different classes that agree enough, in the first band that they share, likest first."""
    sig, root, band = _signatures(group["sig"]), group["root"].to_numpy(), group["band"][0].as_py()
    side, crossed = group["side"].to_numpy(), group["lo"][0].as_py() != group["hi"][0].as_py()
    found = [np.empty((0, 3), np.int64)]
    for i in range(len(sig) - 1):
        later = np.flatnonzero((root[i + 1 :] != root[i]) & (~np.full(len(sig) - i - 1, crossed) | (side[i + 1 :] != side[i]))) + i + 1
        same = sig[later] == sig[i]
        bands = same.reshape(-1, BANDS, ROWS).all(axis=2)
        keep = (same.sum(axis=1) >= AGREE) & (bands.argmax(axis=1) == band) & bands[:, band]
        found.append(np.column_stack([same.sum(axis=1)[keep], np.full(keep.sum(), i), later[keep]]))
    every = np.concatenate(found)
    every = every[np.argsort(-every[:, 0], kind="stable")]
    return every[:, 1], every[:, 2]


def _named(group: pa.Table) -> pa.Table:
    """The texts of a group that have a candidate."""
    group = group.combine_chunks()
    return group.take(pa.array(np.unique(np.concatenate(_candidates(group)))))


def _spanned(group: pa.Table) -> pa.Table:
    """Links between alike texts that join all classes that any pair joins; pairs that links join already aren't compared."""
    group = group.combine_chunks()
    key, sets = group["key"].to_numpy(), _sets(group["shingles"])
    of = {r: r for r in group["root"].to_pylist()}
    roots = group["root"].to_pylist()

    def find(r: int) -> int:
        while of[r] != r:
            of[r] = r = of[of[r]]
        return r

    out = []
    for i, j in zip(*map(np.ndarray.tolist, _candidates(group))):
        a, b = find(roots[i]), find(roots[j])
        if a != b and alike(sets[i], sets[j]):
            of[b] = a
            out.append((key[i], key[j]))
    return pa.Table.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=_LINKS)


def _linked(texts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``code, root`` of the texts, named by their keys, that differ from the root of their class."""
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    part = F.substring(F.col("sig"), F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))
    dealt = texts.select("key", "sig", band).select("key", "band", F.xxhash64("band", part).alias("at"))
    sizes = written(dealt.groupBy("at").agg(F.count("*").alias("n")).filter("n > 1").withColumn("copies", F.col("n")), "sizes")
    members = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = written(joined_evenly(dealt, sizes, ["at"], "copies", members), "bands")
    scored = met.join(met.groupBy("key").agg(F.sum("n").alias("score")), "key")
    hubs = written(scored.groupBy("at").agg(F.max_by("key", F.struct("score", "key")).alias("hub"), F.count("*").alias("copies")), "hubs")
    pairs = joined_evenly(met, hubs, ["at"], "copies", members).filter("key <> hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
    likely = written(_agreeing(written(pairs, "pairs"), texts), "likely")
    links = written(_confirmed(likely, texts).unionByName(_code_links(texts)), "links")
    found = written(components(links).select(F.col("node").alias("key"), "root"), "classes")
    rooted = written(met.join(found, "key", "left").withColumn("root", F.coalesce("root", "key")), "rooted")
    several = rooted.groupBy("at").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("copies")).filter("low < high").select("at", "copies")
    left = joined_evenly(rooted, written(several, "several"), ["at"], "copies", members)
    chunks = F.when(F.col("n") <= limit, 1).otherwise(F.ceil(2 * F.col("n") / limit))
    left = left.withColumn("chunks", chunks.cast("int")).withColumn("own", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
    spread = left.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    placed = spread.select("at", "band", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own").alias("side"), "key", "root")
    group = ["at", "lo", "hi"]
    fields = "at long, band int, lo int, hi int, side int, key long, root long, sig binary"
    named = placed.join(texts.select("key", "sig"), "key").select("at", "band", "lo", "hi", "side", "key", "root", "sig").groupBy(*group).applyInArrow(_named, fields)
    with_sets = written(named, "named").join(texts.select("key", "shingles"), "key")
    more = with_sets.groupBy(*group).applyInArrow(_spanned, "a long, b long")
    return components(links.unionByName(more)).select(F.col("node").alias("code"), "root")


def without_near_copies(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row of each class, with all its columns: that of the smallest id, null ids last, then of the smallest key."""
    session(docs.sparkSession)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key().alias("key"), docs["text"].cast("string").alias("text"))
    made = written(_sketches(texts.select("doc_id", "key", "text")), "sketches")
    distinct = written(made.groupBy("key").agg(F.first("code").alias("code"), F.first("sig").alias("sig"), F.first("shingles").alias("shingles")), "texts")
    found = written(_linked(distinct, limit), "linked")
    return one_of_each(docs, made.groupBy("doc_id", F.col("key").alias("code")).agg(F.count("*").alias("rows")), found, text_key())
