"""A corpus from raw documents to token ids, in stages that each read the table the last one wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, mixing, near_copies, quality, secret_scan
from lectern.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, with all their columns.

    A null text is scored as an empty one; without labels every score is 0.5 and all stay; null ids stay or go by their
    score; repeated rows stay or go together; very long texts are read whole; an empty table stays empty; columns of
    any name are kept.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, with all its columns: SimHash codes within 2 bits, or five-word shingles of similarity 0.8.

    Null and empty texts are one class. The smallest id stays, null ids last, then the smallest hash of the text; of
    repeated rows one stays. Texts of fewer than five words are one shingle; very long texts are compared whole; an
    empty table stays empty; columns of any name are kept.
    """
    return near_copies.without_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of a secret in their texts replaced by ``[SECRET]``.

    A null text stays null, ids aren't read, overlapping spans are replaced once, repeated rows get equal texts, texts
    have no length limit, an empty table stays empty, and columns of any name are kept; ``n_chars`` counts the new text.
    """
    return secret_scan.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none to three times, with all their columns.

    A null text has size 0; a null source is a source of its own; a source without words takes nothing; rows alike in id
    and text have draws of their own; an empty table stays empty; columns of any name are kept.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, n_split, ids`` of every row.

    A null or empty text has no ids; null ids are kept; repeated rows have equal ids; texts have no length limit; other
    columns are left out; an empty table gives an empty one.
    """
    return bpe.round_trip(docs, ids=True)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: Training, fingerprints and tokens can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
