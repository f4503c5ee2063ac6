"""Sharding by jump consistent hashing (Lamping and Veach 2014), in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked

#: Fixed values of the published algorithm: the generator's multiplier, in halves of 32 bits.
MULTIPLIER = 2862933555777941757
LOW32 = 0xFFFFFFFF


def _times32(x: Column, y: int) -> Column:
    """x * y modulo 2**32 for halves of 32 bits, without an overflow."""
    return (x.bitwiseAND(0xFFFF) * y + F.shiftleft((F.shiftright(x, 16) * y).bitwiseAND(0xFFFF), 16)).bitwiseAND(LOW32)


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among ``shards``, and among one more.

    The points at which a key moves as shards are added form one rising sequence; the last point under a count is its shard. So one pass
    gives both answers, and ``grown`` differs from ``shard`` only where it is the new shard. A null key counts as 0. Each jump moves on by
    one shard at least, so shards + 1 steps end it; about ln(shards) of them do something.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    high, low = MULTIPLIER >> 32, MULTIPLIER & LOW32
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("h"), key.bitwiseAND(LOW32).alias("l"),
        F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
    )

    def step(s: Column, _: Column) -> Column:
        p = F.shiftright(s.l, 16) * low
        t = s.l.bitwiseAND(0xFFFF) * low + F.shiftleft(p.bitwiseAND(0xFFFF), 16) + 1
        h = (F.shiftright(t, 32) + F.shiftright(p, 16) + _times32(s.h, low) + _times32(s.l, high)).bitwiseAND(LOW32)
        jumped = ((s.j + 1) * (F.lit(2147483648.0) / (F.shiftright(h, 1) + 1))).cast("long")
        moved = F.struct(h.alias("h"), t.bitwiseAND(LOW32).alias("l"), jumped.alias("j"), F.when(s.j < shards, s.j).otherwise(s.a).alias("a"), s.j.alias("b"))
        return F.when(s.j > shards, s).otherwise(moved)

    end = lambda s: F.struct(s.a.cast("int").alias("shard"), s.b.cast("int").alias("grown"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, step, end)


def shard(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Deal rows into shards by their key; one output row for each input row.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, law (always ``key``), shard, slot (place in the shard, from 0, gapless,
    by rising key), grown_shard (the shard with one more). Integer keys are hashed as they are, others by xxhash64. A null text has size 1
    and the crc of an empty one; a null key counts as 0; repeated rows keep one slot each. Other columns of docs play no part.
    """
    kind = dict(docs.dtypes)[key]
    hashed = F.col(key) if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    at = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        jump(hashed, shards).alias("_j"),
    )
    flat = at.select("doc_id", "size", "text_crc32", F.col("_j.shard").alias("shard"), F.col("_j.grown").alias("grown_shard"))
    return ranked(flat, ["shard"], ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("rank").cast("long").alias("slot"), "grown_shard"
    )
