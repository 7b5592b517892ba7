"""Sharding by jump consistent hashing, in DataFrame expressions only.

Jump consistent hashing (Lamping and Veach, 2014) walks a linear congruential generator seeded with the key; each
draw says at which shard count the key next moves. No ring table is kept, and appending a shard moves a key only
into the new shard.

Columns: doc_id, size (UTF-8 bytes + 1), text_crc32, law ('key'), shard, slot, grown_shard.

Defined cases: a null text counts as the empty text (size 1, checksum 0); a null doc_id hashes like 0; an id that is no
whole number takes its 64-bit hash as the key; rows that
repeat doc_id and text all stay and get neighbouring slots; an empty table gives an empty result; any further columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

#: Fixed value: the multiplier of the generator in the published algorithm, 2862933555777941757, as 16-bit limbs, lowest first.
MULTIPLIER = 2862933555777941757
LIMBS = [(MULTIPLIER >> (16 * k)) & 0xFFFF for k in range(4)]
M16, M32 = 0xFFFF, 0xFFFFFFFF
#: Slots are counted in SLICES parts of each shard, whatever the size of the table; a part is small enough for one task
#: up to some 10^11 rows.
SLICES = 4096
#: Slots of one repeated row that are written at once.
BLOCK = 1 << 16


def _halves(key):
    """The low and high 32 bits of a 64-bit integer, as non-negative longs."""
    return key.bitwiseAND(F.lit(M32)), F.shiftrightunsigned(key, 32)


def _next(lo, hi):
    """The generator's step key * MULTIPLIER + 1 modulo 2^64 on 32-bit halves; no product exceeds 2^49, so ANSI mode never overflows."""
    t0, t1 = lo * LIMBS[0], lo * LIMBS[1]
    low = t0 + F.shiftleft(t1.bitwiseAND(F.lit(M16)), 16) + 1
    high = F.shiftright(low, 32) + F.shiftright(t1, 16) + lo * LIMBS[2] + F.shiftleft((lo * LIMBS[3]).bitwiseAND(F.lit(M16)), 16)
    high = high + hi * LIMBS[0] + F.shiftleft((hi * LIMBS[1]).bitwiseAND(F.lit(M16)), 16)
    return low.bitwiseAND(F.lit(M32)), high.bitwiseAND(F.lit(M32))


def jump_shards(key, shards: int):
    """A struct (shard, grown) of the key's shard among `shards` and among `shards + 1`.

    State: b, the last shard taken; j, the next jump; the generator's halves. The walk for one more shard goes on from
    where the walk for `shards` ended, so both come from one pass of at most shards + 1 steps.
    """
    lo, hi = _halves(key)

    def step(s, _):
        low, high = _next(s["lo"], s["hi"])
        draw = F.shiftright(high, 1) + 1  # the generator's upper 31 bits, plus 1
        jump = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("long")
        moved = F.struct(
            F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"),
            s["j"].alias("grown"), jump.alias("j"), low.alias("lo"), high.alias("hi"),
        )
        return F.when(s["j"] < shards + 1, moved).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(-1).cast("long").alias("grown"), F.lit(0).cast("long").alias("j"), lo.alias("lo"), hi.alias("hi"))
    steps = F.array(*[F.lit(i) for i in range(shards + 1)])
    return F.aggregate(steps, start, step)


def shard_documents(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", slices: int = SLICES) -> DataFrame:
    """Assign every row to a shard by its id alone and number the rows of a shard without gaps.

    The text is reduced to its size and checksum in the scan. Equal rows are counted before the shuffle, so that a row
    repeated without end is one row there; slots come from counts per (shard, slice) and a running sum over slices.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    whole = isinstance(docs.schema[doc_id].dataType, IntegralType)
    own = F.col(f"`{doc_id}`").cast("long") if whole else F.xxhash64(F.col(f"`{doc_id}`"))
    key = F.when(F.col(f"`{doc_id}`").isNull(), F.lit(0).cast("long")).otherwise(own)
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), key.alias("_key"),
    ).groupBy("doc_id", "size", "text_crc32", "_key").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_jump", jump_shards(F.col("_key"), shards)).select(
        "doc_id", "size", "text_crc32", "_n", F.col("_jump.shard").cast("int").alias("shard"), F.col("_jump.grown").cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(slices)).cast("int").alias("_slice"),
    )
    slice_of = Window.partitionBy("shard", "_slice").orderBy("doc_id", "text_crc32", "size")
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_slice").agg(F.sum("_n").alias("_rows")).select(
        "shard", "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0).cast("long")).alias("_start"))
    placed = rows.withColumn("_at", F.sum("_n").over(slice_of.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n"))
    return placed.join(starts, ["shard", "_slice"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_start") + F.col("_at")).alias("_first"), "_n", "grown_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(BLOCK).cast("long"))).alias("_block"),
    ).select(
        "doc_id", "size", "text_crc32", "law", "shard",
        F.explode(F.sequence(F.col("_first") + F.col("_block"), F.col("_first") + F.least(F.col("_block") + BLOCK, F.col("_n")) - 1)).alias("slot"), "grown_shard",
    )
