"""Groups of fingerprints within which all pairs inside a Hamming radius meet.

``radius + 1`` blocks cover the bits, so two fingerprints within the radius agree on a block; one copy of each
fingerprint goes to each block's table, permuted to bring the block to the front of the key. A group above ``limit``
is dealt again by blocks of the bits that its key leaves free, level by level, until it is small: as the codes are
distinct, ``f`` free bits leave at most ``2**f`` of them, so the end is reached without dropping anything. Only blocks
that hold such groups are dealt again, all of a level by one lookup in a small table of masks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Codes of a group that one task looks at together.
LIMIT = 4096


@dataclass
class Block:
    """A table of permuted codes: the bits of its key, and the tables that come before it at each level."""

    mask: int
    earlier: tuple[int, ...] = ()
    below: list[Block] = field(default_factory=list)
    number: int = 0


def blocks(width: int, radius: int, fixed: Block | None = None) -> list[Block]:
    """``radius + 1`` blocks over the bits that ``fixed`` leaves free, as equal as they can be."""
    mask, earlier = (fixed.mask, fixed.earlier) if fixed else (0, ())
    free = [i for i in range(width) if not mask >> i & 1]
    made, at = [], 0
    for k in range(radius + 1):
        take = (len(free) + radius - k) // (radius + 1)
        made.append(mask | sum(1 << i for i in free[at : at + take]))
        at += take
    return [Block(m, (*earlier, *made[:k])) for k, m in enumerate(made)]


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def words_of(value: int, words: int) -> list[int]:
    return [signed(value >> 64 * (words - 1 - k) & (1 << 64) - 1) for k in range(words)]


def _dealt(codes: DataFrame, names: list[str], made: dict[int, list[Block]], more: list[str]) -> DataFrame:
    """A copy of each row for each of the blocks that ``made`` has for the row's ``block``."""
    masks = [(parent, b.number, *words_of(b.mask, len(names))) for parent, some in made.items() for b in some]
    table = codes.sparkSession.createDataFrame(masks, "block int, next int, " + ", ".join(f"m_{n} long" for n in names))
    met = codes.select("block", *names, *more).join(F.broadcast(table), "block")
    return met.select(F.col("next").alias("block"), *[F.col(n).bitwiseAND(F.col(f"m_{n}")).alias(f"key_{n}") for n in names], *names, *more)


def groups(codes: DataFrame, names: list[str], radius: int, more: list[str] = [], limit: int = LIMIT) -> tuple[DataFrame, dict[int, Block]]:
    """``block``, key columns and ``members`` (array of structs of ``names`` and ``more``), and the block of each number.

    ``codes`` has distinct rows of ``names``, 64-bit words with the highest bits first. Groups have 2 to ``limit``
    members.
    """
    width, known = 64 * len(names), {}

    def number(made: list[Block]) -> list[Block]:
        for b in made:
            b.number = len(known)
            known[b.number] = b
        return made

    keys, whole = ["block", *[f"key_{n}" for n in names]], []
    dealt = _dealt(codes.withColumn("block", F.lit(-1)), names, {-1: number(blocks(width, radius))}, more)
    while True:
        counts = dealt.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
        # beside the counts a group has its rows alone, and what is too large is dealt again before it is gathered
        met = written(dealt.join(counts, keys), "met")
        whole.append(met.filter(F.col("n") <= limit))
        hot = met.filter(F.col("n") > limit)
        again = sorted(r.block for r in hot.select("block").distinct().collect())  # a few blocks
        if not again:
            break
        dealt = _dealt(hot, names, {parent: number(blocks(width, radius, known[parent])) for parent in again}, more)
    out = whole[0]
    for x in whole[1:]:
        out = out.unionByName(x)
    return out.groupBy(*keys).agg(F.collect_list(F.struct(*names, *more)).alias("members")), known
