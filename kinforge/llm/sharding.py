"""Sharding: balanced contiguous shards from global byte-size prefix sums.

Documents are put in ascending ``doc_id`` order (equal ids by checksum) by a range partitioning of
their sizes alone; the text never leaves the scan. Each partition keeps a running byte sum and its
total; the totals, one row a partition, become each partition's base; base plus running sum is a
document's global start, and equal targets over the grand total cut the shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.llm.common import Batches, batch, mapped, shuffle_partitions, stored, texts

_RUNNING = "doc_id long, size long, text_crc32 long, part int, nth long, before long"
_RUNNING_ARROW = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("text_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("before", pa.int64())])


def _running(batches: Batches) -> Batches:
    """Number the rows of one partition and sum the sizes before each."""
    rows = before = 0
    for b in batches:
        size = b.column("size").to_numpy()
        ends = np.cumsum(size)
        yield batch(_RUNNING_ARROW, b.column("doc_id"), b.column("size"), b.column("text_crc32"), b.column("part"), rows + np.arange(len(size)), before + ends - size)
        rows, before = rows + len(size), before + int(ends[-1]) if len(size) else before


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: size is the text's UTF-8 bytes plus 1.

    A document goes to the shard that holds the middle of its byte range, so a shard is off the equal
    target by at most one document. Slots number a shard's documents from 0 in order. Null text: no
    bytes. Null ids come first. Rows that repeat keep a slot each; which of two equal rows comes first
    makes no difference. Empty table: empty result. A document longer than a target leaves the shards
    that it spans without rows.
    """
    spark = docs.sparkSession
    sized = texts(docs).select(
        "doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("tie")
    )
    order = ["doc_id", "text_crc32", "size", "tie"]
    dealt = sized.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = stored(mapped(dealt.select("doc_id", "size", "text_crc32", "part"), _running, _RUNNING), "sizes")
    # One row a partition of the range exchange: their number is a setting, not the data's size.
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("docs"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base"), F.coalesce(F.sum("docs").over(ahead), F.lit(0)).alias("base_docs"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    placed = rows.join(F.broadcast(bases), "part").select(
        "doc_id", "size", "text_crc32", (F.col("base_docs") + F.col("nth")).alias("nth"),
        F.expr(f"cast(least({shards - 1}, floor((base + before + size / 2.0D) * {shards} / total)) as int)").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first_nth"))
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("nth") - F.col("first_nth")).alias("slot"))
