"""Batches of texts or signals that are padded to the longest, under a budget of padded size.

Items are dealt to ranges of length, each a fixed ratio wide, so that padding within a
range is bounded. A range's batch size is the budget over its longest item. Large ranges
are cut by a hash of the key, so no window grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lengths in a range differ by less than this ratio.
RATIO = 1.1
#: Items that one window orders at most, about.
GROUP_ITEMS = 100_000


def range_bounds(ratio: float = RATIO, most: int = 2**31) -> list[int]:
    """Least lengths of the ranges from the second on: whole numbers, each at least one more than the last."""
    out, bound = [], 2
    while bound < most:
        out.append(bound)
        bound = max(bound + 1, int(bound * ratio))
    return out


def length_range(n: Column, ratio: float = RATIO) -> Column:
    """Number of a length's range, from 0."""
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in range_bounds(ratio)]), lambda b: b <= n))


def packed(items: DataFrame, budget: int, key: str = "item_id", ratio: float = RATIO, group: int = GROUP_ITEMS) -> DataFrame:
    """`items` (key, n: length) with size_range, part, batch (numbers from 0 in each) and slots, the padded length.

    The padded size of a batch, its items times its slots, is at most `budget`, unless an
    item alone is longer: that is a batch of its own. Null lengths count as 0. Items of a
    range are ordered by length, the longest first, then by key.
    """
    held = items.withColumn("__n", F.coalesce(F.col("n"), F.lit(0)).cast("long")).withColumn("size_range", length_range(F.col("__n"), ratio))
    sizes = held.groupBy("size_range").agg(F.count("*").alias("k"), F.max("__n").alias("__most"))
    parts = sizes.select("size_range", "__most", F.ceil(F.col("k") / group).alias("parts"))  # a row a range
    held = held.join(F.broadcast(parts), "size_range").withColumn("part", F.pmod(F.xxhash64(key), F.col("parts")))
    order = Window.partitionBy("size_range", "part").orderBy(F.col("__n").desc(), key)
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("__most"), F.lit(1))))
    held = held.withColumn("batch", F.floor((F.row_number().over(order) - 1) / per))
    slots = F.max("__n").over(Window.partitionBy("size_range", "part", "batch"))
    return held.withColumn("slots", slots).drop("__n", "__most", "parts")


def batch_waste(batches: DataFrame) -> DataFrame:
    """size_range, part, batch, n_items, padded and waste (what is padding) of each batch of packed()."""
    held = batches.groupBy("size_range", "part", "batch").agg(F.count("*").alias("n_items"), (F.count("*") * F.max("slots")).alias("padded"), F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("used"))
    return held.select("size_range", "part", "batch", "n_items", "padded", (F.col("padded") - F.col("used")).alias("waste"))
