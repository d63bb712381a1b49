"""Balanced contiguous shards from a global prefix sum of byte sizes.

Rows are range-partitioned on their order; each partition's total size and count give the offset of the next one;
a running sum inside each partition completes the prefix sum. Shard ``k`` takes the rows whose bytes begin in
[k, k + 1) / shards of all bytes, so shards are contiguous and their sizes differ by one row's size at most.

Only order columns, sizes and checksums are moved, never texts. Null texts count no bytes (every row counts one more,
for its line end). Null order values come first; equal rows keep any order among themselves. An empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import query, save, table

SHARDS = 16


def text_size(text: Column | str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def byte_shards(docs: DataFrame, order: list[str], text: str = "text", shards: int = SHARDS) -> DataFrame:
    """The ``order`` columns with size, text_crc32, shard and slot (row number in the shard, from 0)."""
    spark = docs.sparkSession
    key = [f"k{i}" for i in range(len(order))]
    rows = docs.select(
        *(F.col(c).alias(k) for c, k in zip(order, key, strict=True)),
        text_size(text).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    by = [*key, "text_crc32", "size"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = save(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()))
    # One row for each partition: the window over them is as small as their number.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .withColumns(
            {
                "bytes_before": F.coalesce(F.sum("bytes").over(before), F.lit(0)),
                "rows_before": F.coalesce(F.sum("rows").over(before), F.lit(0)),
                "all_bytes": F.sum("bytes").over(W.partitionBy()),
            }
        )
    )
    inside = W.partitionBy("part").orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    begin = F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")
    placed = ranged.join(F.broadcast(totals), "part").withColumns({"begin": begin, "at": F.col("rows_before") + F.row_number().over(inside.rowsBetween(W.unboundedPreceding, 0)) - 1})
    shard = F.expr(f"cast(begin * cast({shards} as decimal(20,0)) div all_bytes as int)")
    # One row for each partition again: the first row of every shard.
    placed = save(placed.select(*key, "size", "text_crc32", shard.alias("shard"), "at"))
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    out = placed.join(F.broadcast(first), "shard")
    return out.select(
        *(F.col(k).alias(c) for c, k in zip(order, key, strict=True)), "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot")
    )


@query("op7_shards")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    shards = byte_shards(table(spark, sf, "documents"), ["doc_id"])
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
