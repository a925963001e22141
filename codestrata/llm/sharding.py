"""Balanced contiguous shards from global byte prefix sums (operator 1).

Rows in the order of their id are dealt into ranges; each range gives one total, the totals give every range its start,
and a running sum within the range gives each row its place in the whole table.  A row belongs to the shard in whose
n-th part of all bytes its middle byte lies, so shards are contiguous in the order and their sizes differ from equal
targets by less than the largest row.  Only three narrow columns are shuffled, whatever the length of the texts.

Defined cases: a null or empty text has size 1; null ids come first; rows with equal ids follow by CRC and size, and rows
equal in all three are interchangeable; an empty table gives an empty result; the columns of the input other than id and
text are not read; a row larger than a whole target leaves some shards empty rather than being cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard`` (0 to
    ``n_shards`` - 1), ``slot`` (place in the shard, gapless from 0), ``grown_shard`` (null: only a law of keys has
    one) and ``start_byte`` (bytes of all rows before it).

    ``ranges`` is the number of ranges of the order, four times the shuffle partitions by default.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # The last key only spreads rows that are equal in all others.
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(ranges, "id", "text_crc32", "size", "tie").withColumn("part", F.spark_partition_id())
    # The ranges are drawn from a sample, so they are written down once: both uses below must see the same ones.
    dealt = dealt.checkpoint()

    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("first_byte"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_row"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "text_crc32", "size", "tie")
    placed = (
        dealt.withColumn("sum", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.row_number().over(inside))
        .join(F.broadcast(starts), "part")  # as many rows as ranges
        .withColumn("start_byte", F.col("first_byte") + F.col("sum") - F.col("size"))
        .withColumn("row", F.col("first_row") + F.col("row") - 1)
        # twice the middle byte, so that integers suffice; decimals keep the product exact
        .withColumn("shard", F.expr(f"cast((2 * cast(start_byte AS decimal(20,0)) + size) * {n_shards} div (2 * cast(all_bytes AS decimal(20,0))) AS int)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("shard_row"))
    return placed.join(F.broadcast(firsts), "shard").select(  # as many rows as shards
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("shard_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "start_byte",
    )
