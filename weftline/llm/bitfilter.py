"""A broadcast filter of fixed size: which rows may have a key that another table has.

The filter is a bitmap of hashes, 8 MB at most whatever it was built from. Rows that it rejects need no shuffle to meet
the other table; rows that it lets through are joined as ever, so the fuller it gets, the more rows are shuffled, and
results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, spare_prefix

SLOTS = 1 << 26


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(SLOTS)) + 1


def bit_table(scratch: Scratch, rows: DataFrame, key: Column, name: str) -> DataFrame:
    """The bitmap of the long ``key`` of ``rows``: at most 2048 rows of 4 KB."""
    slots = rows.select(_slot(key).alias("slot"))
    bits = slots.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    return scratch.put(bits, name)


def maybe_in(rows: DataFrame, key: Column, bits: DataFrame, wanted: bool = True) -> DataFrame:
    """The rows whose key may be in the bitmap, or those whose key is not."""
    kept, p = rows.columns, spare_prefix(rows.columns)
    slot, bit = f"{p}slot", F.col(f"{p}at")
    rows = rows.withColumn(slot, _slot(key))
    rows = rows.withColumns({f"{p}to": F.bitmap_bucket_number(slot), f"{p}at": F.bitmap_bit_position(slot)})
    bits = bits.select(F.col("_bucket").alias(f"{p}bucket"), F.col("_bits").alias(f"{p}bits"))
    rows = rows.join(F.broadcast(bits), F.col(f"{p}to") == F.col(f"{p}bucket"), "left")
    byte = F.conv(F.hex(F.substring(f"{p}bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    found = F.coalesce(F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1, F.lit(False))
    return rows.where(found if wanted else ~found).select(*[F.col(f"`{c}`") for c in kept])
