"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_gray import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out_languages

    return held_out_languages(table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import document_fingerprints

    return document_fingerprints(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import held_out_quality

    return held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .ann import EVERY, nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secrets

    return secrets(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    return sharded(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_sizes

    return mixed_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


MIXING_SQL = r"""
with s as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    concat('17:', coalesce(doc_id::varchar, 'null'), ':', coalesce(md5(text), 'null'), ':', row_number() over (partition by doc_id, text)) as name
  from documents
), g as (
  select source, sum(size)::bigint as source_size from s group by source
), w as (
  select *, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::bigint as weight from g
), p as (
  select *, (sum(source_size) over () - 3 * coalesce(sum(source_size) over before, 0))::bigint as spare, (sum(weight) over () - coalesce(sum(weight) over before, 0))::bigint as shared
  from w window before as (order by source_size * (10 // weight), source nulls last rows between unbounded preceding and 1 preceding)
), best as (
  select spare, shared from p order by spare / shared desc, spare desc, shared desc limit 1
), t as (
  select source, source_size, least((w.spare_weight) / shared, (3 * source_size)::double) as target
  from (select g.*, best.spare * g.weight as spare_weight, best.shared from w g, best) w
), r as (
  select s.doc_id, s.name, s.size, t.source_size, t.target, case when t.source_size > 0 then least(t.target / t.source_size, 3.0::double) else 0 end as rate
  from s join t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  size * (floor(rate)::bigint + (('0x' || substr(md5(name), 1, 8))::bigint < floor((rate - floor(rate)) * 4294967296)::bigint)::bigint) as taken
from r
"""


def oracle_sql() -> dict[str, str]:
    """Of the ten, only the mix can be said in SQL; tests hold the others against brute-force versions."""
    return {"op10_source_mixing": MIXING_SQL}
