"""Problems found before narration: kept once by signature, counted by kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Kinds of issues, and those that block.
KINDS = ["automatic_repair", "unknown_g2p_token", "unsupported_phoneme", "oversized_chunk", "empty_narration_unit", "excluded_by_policy", "source_parse_warning"]
BLOCKING = ["unknown_g2p_token", "unsupported_phoneme", "oversized_chunk"]
ISSUES = "book_id string, issue_ord bigint, signature string, kind string, token string, unit_id string, sentence_index int, text string, occurrences bigint, detail string"


def kept_first(issues: DataFrame) -> DataFrame:
    """One row a signature: the first that came, with the occurrences of all, in the order of the first."""
    values = [c for c in issues.columns if c not in ("book_id", "signature", "occurrences", "issue_ord")]
    merged = issues.groupBy("book_id", "signature").agg(F.sum(F.greatest("occurrences", F.lit(1))).alias("occurrences"), F.min("issue_ord").alias("first"), F.min_by(F.struct(*values), "issue_ord").alias("v"))
    order = Window.partitionBy("book_id").orderBy("first")
    return merged.select("book_id", (F.row_number().over(order) - 1).alias("issue_ord"), "signature", "occurrences", *[F.col(f"v.{c}").alias(c) for c in values])


def by_kind(issues: DataFrame) -> DataFrame:
    return issues.groupBy("book_id", "kind").agg(F.sum("occurrences").alias("occurrences"))


def unresolved(issues: DataFrame) -> DataFrame:
    return issues.groupBy("book_id").agg(F.coalesce(F.sum(F.when(F.col("kind").isin(BLOCKING), F.col("occurrences"))), F.lit(0)).alias("unresolved"))


def suggestions(issues: DataFrame) -> DataFrame:
    """Unknown tokens, each once, with an equals sign to fill in; sort by ``token`` when written."""
    return issues.filter("kind = 'unknown_g2p_token' and token is not null").select("book_id", "token").distinct().withColumn("line", F.concat("token", F.lit("=")))
