"""Document fingerprints: weighted SimHash of 256 bits, and all fingerprints within a Hamming radius.

Terms are pairs of neighbouring words, weighted by the bit length of their count in the text; each term's hash votes
with its weight on every bit. Permuted block tables (``hamming``) bring all fingerprints inside the radius together.

Defined results: a null text is empty; a text without words has fingerprint zero and likeness 1 to another such; a
text of one word has that word as its term; documents with the same id, null ids too, follow each other in the order
of their texts' XXH64 (seed 42, signed), a null text as the empty one; null ids come first; a single document is its
own next; repeated rows are neighbours with equal fingerprints; other columns are left out; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, joined_evenly, mixed, parts, session, written
from .hamming import groups

WORDS, RADIUS = 4, 3
CODE = [f"c{k}" for k in range(WORDS)]
SALTS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 for k in range(WORDS)], np.uint64)
#: Terms whose bits are counted at a time.
STRETCH = 1 << 14
_known = WordHashes()


def fingerprint(text: str) -> np.ndarray:
    """The four words of a text's fingerprint."""
    words = text.encode().split()
    if not words:
        return np.zeros(WORDS, np.uint64)
    h = _known.of(words)
    terms = h * np.uint64(0xD6E8FEB86659FD93) if len(h) == 1 else h[:-1] * np.uint64(0xD6E8FEB86659FD93) + (h[1:] << np.uint64(7) | h[1:] >> np.uint64(57))
    terms, counts = np.unique(terms, return_counts=True)
    weights = np.frexp(counts)[1].astype(np.uint8)
    votes = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(terms), STRETCH):
        part = mixed(terms[at : at + STRETCH, None] ^ SALTS)
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1)
        bits *= weights[at : at + STRETCH, None]
        votes += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > int(weights.sum(dtype=np.int64))).view(">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal bits."""
    return 1.0 - int(np.bitwise_count(a ^ b).sum()) / (64 * WORDS)


def digits(code: np.ndarray) -> str:
    return "".join(f"{int(x):016x}" for x in code)


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), *((c, pa.int64()) for c in CODE)]
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, " + ", ".join(f"{c} long" for c in CODE)


def _row(doc_id, text: str, code: np.ndarray, following: str, code_after: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    other = fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digits(code), digits(other), likeness(code, other), likeness(code, code_after), *code.view(np.int64).tolist())


def _batch(rows: list[tuple], more: list[tuple] = []) -> pa.RecordBatch:
    fields = [*_ROW, *more]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


_ENDS = [("piece", pa.int32()), ("place", pa.string()), ("text", pa.string())]
_NONE = (None,) * (len(_ROW) - 1)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair each row of a sorted partition with the one after it; its first and last rows go out with their texts."""
    piece, held = TaskContext.get().partitionId(), None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            code = fingerprint(text)
            if held is None:
                rows.append((doc_id, *_NONE, piece, "first", text))
            else:
                rows.append((*_row(*held, text, code), piece, None, None))
            held = doc_id, text, code
        yield _batch(rows, _ENDS)
    if held is not None:
        yield _batch([(held[0], *_NONE, piece, "last", held[1])], _ENDS)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_row(i, a, fingerprint(a), b, fingerprint(b)) for i, a, b in zip(*(c.to_pylist() for c in batch.columns))])


def with_next(docs: DataFrame) -> DataFrame:
    """The contract's columns and the code words of every row. Texts move once, by ranges of the id.

    Each range is walked in order with one row held back; only the rows at the ends of ranges, two a range, are
    matched afterwards.
    """
    spark = session(docs.sparkSession)
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    # the text's hash decides between equal ids, null ids too, and the place in the input between equal rows, so that
    # neither fills a range
    order = ["doc_id", "hash", "tie"]
    keyed = columns.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    ranged = keyed.repartitionByRange(parts(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    walked = written(ranged.mapInArrow(_along, f"{_DDL}, piece int, place string, text string"), "walked")
    pieces = sorted(r.piece for r in walked.filter("place = 'first'").select("piece").collect())  # one a partition
    after = spark.createDataFrame(list(zip(pieces, pieces[1:] + pieces[:1])), "piece int, next_piece int")
    last = walked.filter("place = 'last'").select("piece", "doc_id", "text")
    first = walked.filter("place = 'first'").select(F.col("piece").alias("next_piece"), F.col("text").alias("following"))
    ends = last.join(after, "piece").join(first, "next_piece").select("doc_id", "text", "following").mapInArrow(_finish, _DDL)
    return walked.filter("place is null").drop("piece", "place", "text").unionByName(ends)


def within(codes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``CODE`` columns and ``others``: the sum of ``copies`` over all other codes within the radius, if any.

    ``codes`` has distinct ``CODE`` rows with ``copies``. A pair counts in the first of the tables that hold it, so
    sums over tables are exact; pairs are never emitted.
    """
    found, known = groups(codes, CODE, radius, ["copies"])
    earlier = {n: np.array([[m >> 64 * (WORDS - 1 - k) & 2**64 - 1 for k in range(WORDS)] for m in b.earlier], np.uint64).reshape(-1, WORDS) for n, b in known.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty((0, WORDS + 1), np.int64)]
            for block, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = np.stack([members.values.field(k).to_numpy(zero_copy_only=False) for k in range(WORDS + 1)], axis=1)
                code, copies = table[:, :WORDS].astype(np.int64).view(np.uint64), table[:, WORDS]
                total = np.zeros(len(table), np.int64)
                for i in range(len(table) - 1):
                    apart = code[i + 1 :] ^ code[i]
                    near = np.flatnonzero(np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= radius)
                    apart = apart[near]
                    for mask in earlier[block]:
                        keep = (apart & mask).any(axis=1)
                        near, apart = near[keep], apart[keep]
                    total[i] += copies[i + 1 + near].sum()
                    total[i + 1 + near] += copies[i]
                out.append(np.column_stack([table[:, :WORDS], total])[total > 0])
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(WORDS + 1)], [*CODE, "others"])

    counted = found.select("block", "members").mapInArrow(run, ", ".join(f"{c} long" for c in CODE) + ", others long")
    return counted.groupBy(*CODE).agg(F.sum("others").alias("others"))


def document_fingerprints(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The contract's columns and ``n_within``: other documents whose fingerprint is within ``radius`` bits."""
    made = written(with_next(docs), "fingerprints")
    codes = written(made.groupBy(*CODE).agg(F.count("*").alias("copies")), "codes")
    near = codes.join(within(codes, radius), CODE, "left").select(*CODE, "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_within"))
    total = codes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    return joined_evenly(made, written(near, "near"), CODE, "copies", total).select(*[n for n, _ in _ROW[:-WORDS]], "n_within")
