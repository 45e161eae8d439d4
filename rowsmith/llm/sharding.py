"""Shards by jump consistent hashing, with DataFrame functions only.

The jump hash (Lamping and Veach, 2014) walks a sequence of ever larger shard numbers that the key
alone decides, and stops before the number of shards. One more shard therefore moves only rows that
jump into it. The walk draws from the published 64-bit linear congruential generator; the state is
kept as two halves of 32 bits, so that no product leaves a signed 64-bit column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table, utf8

# Fixed value of the published generator: 2862933555777941757, as high and low 32 bits.
A_HIGH, A_LOW = divmod(2862933555777941757, 1 << 32)
MASK = (1 << 32) - 1
SHARDS = 24
#: Sub-buckets of a shard within which rows are numbered; a power of two up to 2**32.
BUCKET_BITS = 12


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """(hi, lo) * A + 1 modulo 2**64; every intermediate value stays under 2**63."""
    a1, a0 = divmod(A_LOW, 1 << 16)
    low0 = lo * a0 + 1
    low1 = lo * a1
    total = low0 + F.shiftleft(low1.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(total, 32) + F.shiftright(low1, 16)
    high = carry + (lo * A_HIGH).bitwiseAND(MASK) + (hi * a0).bitwiseAND(MASK) + F.shiftleft((hi * a1).bitwiseAND(0xFFFF), 16)
    return high.bitwiseAND(MASK), total.bitwiseAND(MASK)


def _halves(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32), key.bitwiseAND(MASK)


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of a long key, 0 to shards - 1, and as a struct the shard with one shard more.

    The walk rises by at least one a step, so shards + 1 steps always reach the end.
    """
    hi, lo = _halves(key)
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"))

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        ahead = F.floor((s["at"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1).cast("double"))).cast("long")
        going = s["at"] < shards + 1
        return F.struct(
            F.when(going, hi).otherwise(s["hi"]).alias("hi"), F.when(going, lo).otherwise(s["lo"]).alias("lo"), F.when(going, F.least(ahead, F.lit(shards + 1).cast("long"))).otherwise(s["at"]).alias("at"),
            F.when(s["at"] < shards, s["at"]).otherwise(s["shard"]).alias("shard"), F.when(going, s["at"]).otherwise(s["grown"]).alias("grown"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def deal(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Null text: size 8, checksum 0. Null doc_id: dealt as key 0. Equal doc_ids share a shard and take
    slots of their own. An empty table gives an empty result. Other columns are not read.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))
    bucket = F.shiftright(_next(*_halves(key))[0], 32 - BUCKET_BITS).cast("int")
    d = documents(docs)
    ids = d.select("doc_id", jump_hash(key, shards).alias("j"), bucket.alias("bucket"))
    # At most shards * 2**BUCKET_BITS counts, however many rows there are.
    from pyspark.sql import Window

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy(F.col("j.shard").alias("shard"), "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rows = d.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), F.crc32(utf8(F.col("text"))).alias("text_crc32"), jump_hash(key, shards).alias("j"), bucket.alias("bucket")).select("doc_id", "size", "text_crc32", F.col("j.shard").alias("shard"), F.col("j.grown").alias("grown_shard"), "bucket")
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    numbered = rows.withColumn("rank", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "grown_shard")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deal(table(spark, sf_dir, "documents"))


# DuckDB: the generator on HUGEINT, the walk as a recursive table, CRC-32 byte by byte.
OP7_SQL = """
WITH RECURSIVE
crc_table AS (
  SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, b: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
sums AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
    xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM documents, crc_table),
walk AS (
  SELECT doc_id, (doc_id::HUGEINT * 2862933555777941757 + 1) % 18446744073709551616 AS k, 0 AS pos,
    floor(2147483648.0::DOUBLE / (((doc_id::HUGEINT * 2862933555777941757 + 1) % 18446744073709551616 >> 33) + 1)::DOUBLE)::BIGINT AS ahead
  FROM documents
  UNION ALL
  SELECT doc_id, k2, ahead, floor((ahead + 1) * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757 % 18446744073709551616 + 1) % 18446744073709551616 AS k2 FROM walk WHERE ahead < 25)),
shard AS (
  SELECT doc_id, max(pos) FILTER (WHERE pos < 24) AS shard, max(pos) AS grown, ((doc_id::HUGEINT * 2862933555777941757 + 1) % 18446744073709551616) >> 52 AS bucket
  FROM walk GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM sums JOIN shard USING (doc_id)
"""
