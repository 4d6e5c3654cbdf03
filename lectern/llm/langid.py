"""Language identification by a byte convolutional network, trained in numpy on labelled texts.

Bytes are embedded; filters of several widths slide over fixed-length windows, each filter keeps its largest answer,
and a softmax layer reads those. A text is cut into windows that overlap by the widest filter less one byte, so every
sequence that a filter can see is seen; the windows' probabilities are averaged by their bytes.

Training takes a bounded sample: of each language, whatever their number, the ``TEXTS`` different texts with the least
hashes (fewer if there are so many languages that all would pass ``TOTAL``, but never below ``LEAST``), and ``CUTS``
evenly spaced windows of each. Copies of a text count once. Prediction reads whole texts and nothing else.

Defined results: a null text or one without a letter (a character of Unicode's category L) is ``und`` with score 0, and
so is every text when there is nothing to learn from; equal texts get bit-equal results wherever they stand, as a text
goes through the network alone; a language with a single text is learned from that; null ids are kept, in no fold;
other columns are left out; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_of, decoded, session

#: Bytes of a window, sizes of the embedding, widths of the filters and filters of each width.
LENGTH, EMBED, WIDTHS, FILTERS = 128, 8, (2, 3, 4), 16
#: Texts of each language in the training sample, windows of each, texts of all languages together, and the least of one.
TEXTS, CUTS, TOTAL, LEAST = 600, 8, 60_000, 8
FOLDS, HELD_OUT = 4, 2
#: Windows that go through the network together.
BATCH = 256
WIDE = max(WIDTHS)


def has_letter(text: bytes) -> bool:
    import regex

    return regex.search(r"\p{L}", text.decode()) is not None


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text, the last padded with zero bytes, and the number of bytes that each has of its own."""
    step = LENGTH - WIDE + 1
    n = max(1, math.ceil((len(text) - WIDE + 1) / step))
    padded = np.zeros((n - 1) * step + LENGTH, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    own = np.minimum(len(text) - np.arange(n) * step, LENGTH)
    return np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[::step], own


def _mask() -> np.ndarray:
    """Filters narrower than the widest have no weight on its last bytes."""
    mask = np.zeros((WIDE, EMBED, FILTERS * len(WIDTHS)), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask.reshape(WIDE * EMBED, -1)


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def answers(self, rows: np.ndarray) -> np.ndarray:
        """Every filter's answer at every place of each window."""
        x = self.embed[rows].reshape(len(rows), -1)
        places = LENGTH - WIDE + 1
        patches = np.lib.stride_tricks.as_strided(x, (len(rows), places, WIDE * EMBED), (x.strides[0], 4 * EMBED, 4))
        return (patches.reshape(-1, WIDE * EMBED) @ self.filters).reshape(len(rows), places, -1)

    def head(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def predict(self, text: bytes) -> tuple[str, float]:
        """The likeliest language and its probability. One text at a time: what else a batch holds can't change a bit."""
        rows, own = windows(text)
        p = np.zeros(len(self.languages))
        for i in range(0, len(rows), BATCH):
            p += own[i : i + BATCH] @ self.head(self.answers(rows[i : i + BATCH]).max(axis=1)).astype(np.float64)
        p /= own.sum()
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, max(0.0, p[best])))


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 4, seed: int = 7, rate: float = 3e-3) -> Network:
    """Fit a network to windows by Adam; the order of the rows and the seed decide the result."""
    rng = np.random.default_rng(seed)
    wide, many, mask = WIDE * EMBED, FILTERS * len(WIDTHS), _mask()
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(languages, normal(0.5, 256, EMBED), normal(0.3, wide, many) * mask, np.zeros(many, np.float32), normal(0.2, many, len(languages)), np.zeros(len(languages), np.float32))
    names = ["embed", "filters", "bias", "out", "out_bias"]
    first, second, steps = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2)), None, 0
    first, second = first
    size = 64
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), size):
            pick = order[at : at + size]
            x, y = rows[pick], labels[pick]
            answers = net.answers(x)
            place = answers.argmax(axis=1)
            pooled = np.take_along_axis(answers, place[:, None, :], 1)[:, 0, :]
            hidden = np.maximum(pooled + net.bias, 0)
            p = net.head(pooled)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            g = (p @ net.out.T) * (hidden > 0)
            seen = x[np.arange(len(x))[:, None, None], place[:, :, None] + np.arange(WIDE)]  # batch, filter, byte
            patch = net.embed[seen].reshape(len(x), many, wide)
            to_embed = np.zeros_like(net.embed)
            np.add.at(to_embed, seen, (g[:, :, None] * net.filters.T).reshape(len(x), many, WIDE, EMBED))
            grads = {"out": hidden.T @ p, "out_bias": p.sum(0), "bias": g.sum(0), "filters": np.einsum("bf,bfw->wf", g, patch, optimize=True) * mask, "embed": to_embed}
            steps += 1
            step = rate * (1 - epoch / epochs) * math.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
            for n in names:
                first[n] += 0.1 * (grads[n] - first[n])
                second[n] += 0.001 * (grads[n] ** 2 - second[n])
                getattr(net, n)[...] -= (step * first[n] / (np.sqrt(second[n]) + 1e-7)).astype(np.float32)
    return net


def sample(docs: DataFrame, texts: int = TEXTS, cuts: int = CUTS, total: int = TOTAL) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows, labels and languages of the ``texts`` different texts of each language that have the least hashes.

    A sketch counts the different texts of each language, and a threshold on the hash that follows from it keeps all but
    a few times as many as are wanted from being looked at; a text's copies are merged before they move. What reaches
    the driver is one row a language and the chosen windows.
    """
    known = docs.filter("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("hash"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()}  # one row a language
    if not counts:
        return np.empty((0, LENGTH), np.uint8), np.empty(0, int), []
    each = max(LEAST, min(texts, total // len(counts)))
    shares = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, 4 * each / max(1, n))))])
    drawn = F.pmod(F.col("hash"), F.lit(1 << 32)) < F.element_at(shares, F.col("lang")) * (1 << 32)
    once = known.filter(drawn).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("hash", F.lit(1 << 32)), "hash")
    chosen = once.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), decoded(batch.column(1))):
                if has_letter(text):
                    rows, _ = windows(text)
                    out += [(lang, rows[k].tobytes()) for k in sorted({*np.linspace(0, len(rows) - 1, cuts).astype(int).tolist()})]
            langs, rows = zip(*out) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["lang", "bytes"])

    got = sorted((r["lang"], bytes(r["bytes"])) for r in chosen.mapInArrow(cut, "lang string, bytes binary").collect())
    languages = sorted({lang for lang, _ in got})
    place = {lang: k for k, lang in enumerate(languages)}
    return np.frombuffer(b"".join(b for _, b in got), np.uint8).reshape(-1, LENGTH), np.array([place[lang] for lang, _ in got], int), languages


def fit(docs: DataFrame, texts: int = TEXTS) -> Network | None:
    """A network learned from ``text`` and ``lang`` of ``docs``; None if there is nothing to learn from."""
    session(docs.sparkSession)
    rows, labels, languages = sample(docs, texts)
    return train(rows, labels, languages) if languages else None


def languages_of(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row. One pass without a shuffle; the network has about 400 bytes a language and 20 kilobytes."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = decoded(batch.column(1))
            found = {t: net.predict(t) if net and has_letter(t) else ("und", 0.0) for t in set(texts)}
            langs, scores = zip(*map(found.__getitem__, texts)) if texts else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    session(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Learn from the folds that the contract allows and predict every row."""
    fold = bucket_of("doc_id", FOLDS)
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    predicted = languages_of(columns, fit(columns.filter(fold != HELD_OUT)))
    return predicted.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
