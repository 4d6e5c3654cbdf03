"""Quality classifier: random-indexing word vectors pooled over a text, and a two-layer network in numpy.

Every context has a sparse random index vector. A word's vector adds the index vectors of its letter trigrams and its
shape and, for the frequent words of the training sample, those of the words around it there. A text's features are
the mean of its words' vectors, how much of their length the mean keeps (repeated words add up, varied ones cancel) and
the logarithm of its length. Two more tell how often a
word follows itself and how many words differ. The network's logit is divided by a temperature that fits a held-back part of the sample.

Training takes a bounded sample of labelled texts, drawn by a hash of the id; scoring reads whole texts and nothing
else.

Defined results: a null or empty text is scored as a text without words; without labels every score is 0.5; a
document with several labels is learned with each; equal texts get bit-equal scores wherever they stand; words of any
length are read whole; null ids are kept, in no fold;
other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, decoded, session

#: Labelled texts of the training sample, about; frequent words that keep contexts; neighbours on each side.
TEXTS, VOCABULARY, AROUND = 6000, 20_000, 2
#: Length of index vectors, their non-zero entries, index vectors for letter trigrams and shapes.
WIDTH, ONES, CONTEXTS = 64, 4, 8192
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Weight decay of the network.
DECAY = 5e-3
#: Words whose vectors a worker keeps: about 100 MB.
KEPT = 250_000


def index_vectors(n: int = CONTEXTS, width: int = WIDTH, ones: int = ONES, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((n, width), np.float32)
    places = rng.random((n, width)).argsort(axis=1)[:, :ones]
    np.put_along_axis(out, places, rng.choice([-1.0, 1.0], (n, ones)).astype(np.float32), 1)
    return out


def _classes() -> np.ndarray:
    """A class for every byte: capitals, small letters with all bytes above ASCII, digits, and each other byte alone."""
    out = np.arange(256, dtype=np.uint32)
    out[ord("A") : ord("Z") + 1], out[ord("0") : ord("9") + 1] = ord("A"), ord("0")
    out[ord("a") : ord("z") + 1] = out[128:] = ord("a")
    return out


CLASS = _classes()
#: Bytes of a word that are read in one piece; pieces read together; bytes of texts scored together.
PIECE, TOGETHER, GROUP = 256, 4096, 1 << 18


def word_vectors(words: list[bytes], index: np.ndarray) -> np.ndarray:
    """Unit vectors of words: the index vectors of their letter trigrams and, twice, of the changes of byte class.

    Long words are read in pieces that share two bytes, and the pieces' sums added up. Of an index vector only the
    entries that aren't zero are added.
    """
    sums = np.zeros((len(words), WIDTH), np.float32)
    places = index.nonzero()[1].reshape(len(index), -1)
    signs = np.take_along_axis(index, places, 1)
    # all pieces of a word but the last leave its last change to the next one
    cut = ((k, w[at : at + PIECE], at + PIECE >= len(w)) for k, w in ((k, b"\x01" + w + b"\x02") for k, w in enumerate(words)) for at in range(0, max(1, len(w) - 2), PIECE - 2))
    while some := list(islice(cut, TOGETHER)):
        word, last = np.array([k for k, _, _ in some]), np.array([x for _, _, x in some])
        raw = np.frombuffer(b"".join(p for _, p, _ in some), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(some)), [len(p) for _, p, _ in some])
        gram = np.flatnonzero(owner[2:] == owner[:-2])
        grams = (raw[gram] | raw[gram + 1] << np.uint32(8) | raw[gram + 2] << np.uint32(16)) * np.uint32(0x9E3779B1) >> np.uint32(15)
        kind = CLASS[raw]
        turn = (owner[1:] == owner[:-1]) & (kind[1:] != kind[:-1])
        turn[:-1] &= last[owner[:-2]] | (owner[2:] == owner[:-2])
        turn[-1] &= last[-1]
        turn = np.flatnonzero(turn)
        turns = (kind[turn] << np.uint32(8) | kind[turn + 1]) * np.uint32(0x85EBCA6B) >> np.uint32(13)
        code = np.concatenate((grams, turns)) % CONTEXTS
        of = word[owner[np.concatenate((gram, turn))]] - word[0]
        weight = signs[code]
        weight[len(grams) :] *= 2
        found = np.bincount((of[:, None] * WIDTH + places[code]).ravel(), weight.ravel(), (word[-1] - word[0] + 1) * WIDTH)
        sums[word[0] : word[-1] + 1] += found.reshape(-1, WIDTH).astype(np.float32)
    return sums / np.maximum(1e-6, np.sqrt((sums**2).sum(axis=1, keepdims=True)))


@dataclass
class Model:
    """Word contexts and the network. ``score`` maps texts to probabilities of label 1."""

    known: dict[bytes, int]
    contexts: np.ndarray
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    layers: tuple = ()
    temperature: float = 1.0

    def __post_init__(self):
        self.index = index_vectors()
        self.places: dict[bytes, int] = {}
        self.table = np.zeros((1024, WIDTH), np.float32)
        self.context = np.zeros(1024, np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "places", "table", "context")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.__post_init__()

    def _learn(self, split: list[list[bytes]]) -> None:
        """Place the vectors of all words that the worker doesn't have."""
        fresh = set().union(*split).difference(self.places)
        if len(self.places) + len(fresh) > KEPT:
            self.places.clear()
            fresh = set().union(*split)
        words, at = sorted(fresh), len(self.places)
        while at + len(words) > len(self.table):
            self.table, self.context = np.concatenate([self.table, np.zeros_like(self.table)]), np.concatenate([self.context, np.zeros_like(self.context)])
        self.table[at : at + len(words)] = word_vectors(words, self.index)
        self.context[at : at + len(words)] = [self.known.get(w, 0) for w in words]
        self.places.update(zip(words, range(at, at + len(words))))

    def _features(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(2 * WIDTH + 4, np.float32)
        if words:
            at = np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))
            rows, first, counts = np.unique(at, return_index=True, return_counts=True)
            own = np.argsort(first)  # in the text's own order: places depend on what the worker has seen, and sums on the order
            rows, counts = rows[own], counts[own]
            shares = (counts / len(words)).astype(np.float32)
            out[:WIDTH] = shares @ self.table[rows]
            out[WIDTH : 2 * WIDTH] = shares @ self.contexts[self.context[rows]]
            out[-4] = (at[1:] == at[:-1]).mean() if len(at) > 1 else 0
            out[-3] = np.sqrt(out[:WIDTH] @ out[:WIDTH])
            out[-2] = np.log1p(len(words))
            out[-1] = len(rows) / len(words)
        return out

    def features(self, texts: list[bytes]) -> np.ndarray:
        out, group, held = [np.empty((0, 2 * WIDTH + 4), np.float32)], [], 0
        for k, text in enumerate(texts):
            group.append(text.split())
            held += len(text)
            if held > GROUP or k + 1 == len(texts):
                self._learn(group)
                out.append(np.stack([self._features(words) for words in group]))
                group, held = [], 0
        return np.concatenate(out)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return (np.maximum((x - self.mean) / self.scale @ a + b, 0) @ c + d)[:, 0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not self.layers:
            return np.full(len(texts), 0.5)
        if not texts:
            return np.empty(0)
        # one text at a time, so that what else a batch holds can't change a bit
        z = np.array([self.logits(row[None])[0] for row in self.features(texts)]) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def word_contexts(texts: list[bytes]) -> tuple[dict[bytes, int], np.ndarray]:
    """Of each frequent word, its row, and there the normed sum of the index vectors of its neighbours; row 0 is zero."""
    index, counts = index_vectors(seed=13), Counter()
    for text in texts:
        counts.update(text.split())
    known = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 1]
    del counts
    place = {w: k for k, w in enumerate(known)}
    own = np.array([zlib.crc32(w) % CONTEXTS for w in known], int)
    sums = np.zeros((len(known) + 1, WIDTH), np.float32)
    for text in texts:  # cut again rather than kept: words take many times the space of their text
        at = np.array([place.get(w, -1) for w in text.split()], int)
        for away in range(1, AROUND + 1):
            left, right = at[:-away], at[away:]
            both = (left >= 0) & (right >= 0)
            np.add.at(sums, left[both], index[own[right[both]]])
            np.add.at(sums, right[both], index[own[left[both]]])
    rows = np.concatenate([np.zeros((1, WIDTH), np.float32), sums[:-1] / np.maximum(1e-6, np.sqrt((sums[:-1] ** 2).sum(axis=1, keepdims=True)))])
    return {w: k + 1 for w, k in place.items()}, rows


def train(texts: list[bytes], labels: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 2e-3, seed: int = 5) -> Model:
    """Fit the network by Adam with weight decay, then the temperature; the order of the rows and the seed decide the result."""
    model = Model(*word_contexts(texts))
    if len(texts) < 10 or len(set(labels.tolist())) < 2:
        return model
    rng = np.random.default_rng(seed)
    x = model.features(texts)
    held = np.arange(len(x)) % 5 == 4
    model.mean, model.scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-3
    u, y = ((x - model.mean) / model.scale).astype(np.float32), labels.astype(np.float32)
    normal = lambda scale, *size: rng.normal(0, scale, size).astype(np.float32)
    weights = [normal((2 / x.shape[1]) ** 0.5, x.shape[1], hidden), np.zeros(hidden, np.float32), normal((1 / hidden) ** 0.5, hidden, 1), np.zeros(1, np.float32)]
    first, second, steps = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    fit = np.flatnonzero(~held)
    for epoch in range(epochs):
        order = rng.permutation(fit)
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            before = np.maximum(u[pick] @ weights[0] + weights[1], 0)
            z = (before @ weights[2] + weights[3])[:, 0]
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick))[:, None].astype(np.float32)
            back = (g @ weights[2].T) * (before > 0)
            grads = [u[pick].T @ back + DECAY * weights[0], back.sum(0), before.T @ g + DECAY * weights[2], g.sum(0)]
            steps += 1
            step = rate * (1 - epoch / epochs) * (1 - 0.999**steps) ** 0.5 / (1 - 0.9**steps)
            for w, m, v, d in zip(weights, first, second, grads):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                w -= step * m / (np.sqrt(v) + 1e-7)
    model.layers = tuple(weights)
    z = model.logits(x[held]).astype(np.float64)
    loss = lambda t: float(np.mean(np.logaddexp(0, z / t) - y[held] * z / t))
    model.temperature = float(min(np.geomspace(0.2, 8, 41), key=loss))
    return model


def fit(docs: DataFrame, labels: DataFrame, texts: int = TEXTS) -> Model:
    """Learn from ``doc_id, text`` and ``doc_id, quality``; both are filtered to the rows that may be learned from."""
    session(docs.sparkSession)
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    count = marks.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    drawn = marks.filter(place < min(1.0, texts / max(1, count)) * (1 << 32))
    # about ``texts`` rows of two numbers, never above twice as many: where ids repeat, those of the least hashes
    drawn = drawn.orderBy(place, "doc_id", "quality").limit(2 * texts)
    met = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    met = met.orderBy(place, "doc_id", "quality", F.xxhash64("text")).limit(4 * texts)
    rows = met.select("doc_id", "quality", F.encode("text", "UTF-8").alias("text")).toArrow()
    rows = sorted(zip(rows["doc_id"].to_pylist(), rows["quality"].to_pylist(), rows["text"].to_pylist()))
    order = np.random.default_rng(3).permutation(len(rows))
    return train([rows[k][2] for k in order], np.array([rows[k][1] for k in order]))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row. One pass without a shuffle; the model holds at most ``VOCABULARY`` word vectors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(decoded(batch.column(1))), pa.float64())], ["doc_id", "score"])

    session(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def held_out_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from the folds that the contract allows and score every row."""
    learn = bucket_of("doc_id", FOLDS) != HELD_OUT
    model = fit(docs.select("doc_id", "text").filter(learn), labels.select("doc_id", "quality").filter(learn))
    return scores(docs, model).select(
        "doc_id", F.coalesce(bucket_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that a model learned as in ``held_out_quality`` doesn't reject."""
    learn = bucket_of("doc_id", FOLDS) != HELD_OUT
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text").filter(learn), labels.select("doc_id", "quality").filter(learn)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(decoded(texts)), pa.float64())

    return docs.filter(score(F.col("text").cast("string")) >= threshold)
