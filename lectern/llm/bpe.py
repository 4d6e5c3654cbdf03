"""Byte-level BPE encoding and decoding.

The ranks of a public vocabulary become a vocabulary and merge list of the ``tokenizers`` library; Arrow batches of
whole texts are cut into the pattern's matches, each distinct match is encoded once per worker, and every token is
placed on the characters that it covers. Decoding goes back through the byte table; tokens that hold part of a
character are joined as bytes before UTF-8 is read.

Defined results: a null or empty text has no tokens; texts have no length limit; repeated rows are encoded each on
its own; other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import session

#: Vocabulary file of the query; the path is a parameter everywhere else.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Distinct matches that a worker keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 120_000, 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else the next free one from U+0100."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printing else chr(next(spare)) for b in range(256)]


class ByteBPE:
    """An encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        chars = byte_chars()
        name = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            # any two neighbours that make a token may merge, at the token's rank; the longer left part first
            for cut in range(len(token) - 1, 0, -1):
                if token[:cut] in ranks and token[cut:] in ranks:
                    merges.append((name[token[:cut]], name[token[cut:]]))
        model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in enumerate(chars)}
        self.token_bytes = {i: bytes(back[c] for c in s) for s, i in self.tokenizer.get_vocab().items()}
        self.token_sizes = np.zeros(max(self.token_bytes, default=-1) + 1, np.int64)
        for i, token in self.token_bytes.items():
            self.token_sizes[i] = len(token)
        self.split = regex.compile(pattern or public_tokenizers.PATTERN).findall
        self.kept: dict[str, bytes] = {}

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Of each text, its ids as little-endian unsigned 32-bit integers."""
        kept, cut = self.kept, [self.split(t) if t else [] for t in texts]
        fresh = list(set().union(*cut).difference(kept)) if cut else []
        if len(kept) + len(fresh) > KEPT:
            kept.clear()
            fresh = list(set().union(*cut))
        long = {}
        for piece, ids in zip(fresh, self._encode_pieces(fresh)):
            (kept if len(piece) <= KEPT_CHARS else long)[piece] = ids
        get = kept.__getitem__
        if long:
            return [b"".join([long[p] if p in long else get(p) for p in pieces]) for pieces in cut]
        return [b"".join(map(get, pieces)) for pieces in cut]

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed([text])[0], "<u4").tolist()

    def offsets(self, text: str, ids) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one code point that each token touches; tokens inside one character share it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        sizes = self.token_sizes[np.asarray(ids, np.int64)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        return char_of[starts], char_of[ends - 1] + 1

    def split_tokens(self, raw: bytes, packed: bytes) -> int:
        """How many tokens begin inside a character of the text, by their places in its bytes."""
        if raw.isascii():
            return 0
        sizes = self.token_sizes[np.frombuffer(packed, "<u4")]
        starts = np.cumsum(sizes) - sizes
        return int((np.frombuffer(raw, np.uint8)[starts] & 0xC0 == 0x80).sum())

    def decode_bytes(self, packed: bytes) -> bytes:
        """The bytes of packed ids. An id outside the vocabulary raises KeyError."""
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, ids) -> str:
        """The text of the ids; bytes that are no whole character become U+FFFD, as when a list of ids is cut."""
        return self.decode_bytes(np.asarray(ids, "<u4").tobytes()).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBPE:
    """One encoder for each worker process."""
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``id_col``, ``ids`` (array of int) and, if asked for, ``starts`` and ``ends`` in code points, of every row."""
    path = path or default_path()
    more = ", starts array<int>, ends array<int>" if offsets else ""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("ids", pa.list_(pa.int32()))] + [(n, pa.list_(pa.int32())) for n in ("starts", "ends") if offsets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [np.frombuffer(x, "<u4") for x in coder.packed(texts)]
            columns = [ids]
            if offsets:
                placed = [coder.offsets(t or "", i.tolist()) for t, i in zip(texts, ids)]
                columns += [[p[0] for p in placed], [p[1] for p in placed]]
            arrays = [pa.array([x.astype(np.int32) for x in c], t) for c, (_, t) in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, *(n for n, _ in fields)])

    session(docs.sparkSession)
    return docs.select(id_col, docs[text_col].cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>{more}")


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``text`` of every row of ``ids``; null ids give an empty text."""
    path = path or default_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            texts = [coder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str | None = None, ids: bool = False) -> DataFrame:
    """Encode every text, place and decode its ids, and return the digests of ids and bytes, ``n_split``, the tokens that
    begin inside a character by the offsets, and the ids themselves if asked for.

    One pass without a shuffle: a lost executor costs only the tasks that it ran. The ids of one batch of rows and a
    bounded table of matches are all that a worker holds. Texts that a batch repeats, as a mix of sources does, are
    encoded once.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sha = codec(path), hashlib.sha256
        for batch in batches:
            texts = batch.column(1).to_pylist()
            place = {t: k for k, t in enumerate(dict.fromkeys(texts))}
            at = [place[t] for t in texts]
            packed = coder.packed(list(place))
            raws = map(coder.decode_bytes, packed)
            made = [(len(p) // 4, sha(p).hexdigest(), sha(raw).hexdigest(), coder.split_tokens(raw, p)) for p, raw in zip(packed, raws)]
            columns = list(zip(*[made[k] for k in at])) if at else [[]] * 4
            more = [pa.array([np.frombuffer(packed[k], "<i4") for k in at], pa.list_(pa.int32()))] if ids else []
            kinds = pa.int64(), pa.string(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)], *more], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split", *["ids"] * ids])

    session(docs.sparkSession)
    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return columns.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long" + ", ids array<int>" * ids)
