"""Contiguous shards of near-equal bytes, cut from global prefix sums (DataFrame operations only).

Documents are ranged by id into ordered partitions. Each partition's total is summed; the running
sum over those totals (a table of one row per partition) places every partition in the global byte
order, and a window inside each partition places its rows. A document goes to the shard that holds
its middle byte, so shards are contiguous in id order and differ from the target by less than one
document.

Only the id, the size and the checksum are shuffled, never the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaver.llm.common import Scratch


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """Assign every row to a shard; a row's size is its UTF-8 bytes plus ``overhead``.

    Returns (doc_id, size, text_crc32, shard, slot). A null text has no bytes and checksum 0. Rows of
    equal id are ordered by size, checksum and place in the input; null ids come first. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("seq"),
    )
    order = ["doc_id", "size", "text_crc32", "seq"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a partition's number can't change if it has to be computed again
    ranged = scratch.table(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per partition: its size is bounded by the number of partitions
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("base_bytes"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("base_rows"),
        F.sum("part_bytes").over(every).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("at", F.count("*").over(inside))
        .join(F.broadcast(bases), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("base_rows") + F.col("at")).alias("at"),
            F.expr(f"cast(least({n_shards - 1}, ((2 * (base_bytes + before) + size) * {n_shards}) div (2 * all_bytes)) as int)").alias("shard"),
        )
    )
    placed = scratch.table(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# CRC-32 has no DuckDB function, so the SQL reduces each text's bytes with the usual table of the reversed polynomial.
SQL = """
WITH RECURSIVE steps(n, k, c) AS (
  SELECT n, 0, n::BIGINT FROM range(256) t(n)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM steps WHERE k < 8
),
crc AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
d AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda a, b: xor(a // 256, crc.t[xor(a, b) % 256 + 1]))) AS text_crc32
  FROM documents, crc
),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS all_bytes,
    row_number() OVER (ORDER BY doc_id, size, text_crc32) AS ix FROM d
),
s AS (SELECT *, least(23, ((2 * before + size) * 24) // (2 * all_bytes))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY ix) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""
