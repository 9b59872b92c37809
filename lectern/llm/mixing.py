"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame functions only. Sizes are summed per source; a water level rises until the
targets, weight times level but never above the cap, add up to the wanted total. Each
document is taken as many whole times as its source's ratio of target to size holds; the
fraction left is taken in a seeded random order, document after document, until it is
used up, so that only one document of a group is taken in part. Large sources are cut
into groups by the hash of id and text, and rows with one id, text and source are counted
first and go as one block, so that no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import SPACES, pick, small, staged

#: Weights by the rank of the source.
WEIGHTS = (5, 2, 1)
#: Share of all sizes that the mix has, and times that a source is taken at most.
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17
#: Blocks of a group, about.
GROUP_DOCS = 4096


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACES}]+")), F.lit(0)).cast("long")


def ranked_weights(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, n, weight: the weights in turn, by code point order of the source, null last. A row for each source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double"))


def water_level(sources: DataFrame, total: float, epochs: float = MAX_EPOCHS) -> float:
    """The level at which least(weight * level, epochs * size) adds up to `total`; infinite if all caps are too low.

    Expects weight, source_size. Each round caps what the level exceeds and shares the
    rest by weight; the driver gets three sums.
    """
    cap, level = F.col("source_size") * epochs, 0.0
    while True:
        over = F.col("weight") * level > cap
        capped, weight, n = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count(F.when(over, 1))).first()
        if not weight:
            return float("inf")
        rising = (total - capped) / weight
        if rising <= level:
            return level
        level = rising


def _key(doc_id: Column, text: Column, seed: int) -> Column:
    """Hash of id and text that orders the rows of a group."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("-"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def _blocks(docs: DataFrame, id_col: str, text_col: str, source_col: str, total_share: float, epochs: int, seed: int) -> DataFrame:
    """doc_id, source, size, h, copies, source_size, target, whole, more (words beyond the whole times, of all copies together) of rows alike."""
    rows = pick(docs, doc_id=id_col, source=source_col, text=text_col)
    rows = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key(F.col("doc_id"), F.col("text"), seed).alias("h"))
    rows = staged(rows.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies")), "sizes")
    stats = staged(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n")), "sources")
    stats = staged(ranked_weights(stats), "weights")
    total = (stats.agg(F.sum("source_size")).first()[0] or 0) * total_share
    level = water_level(stats, total, epochs)
    cap = F.col("source_size").cast("double") * epochs
    targets = stats.withColumn("target", cap if level == float("inf") else F.least(F.col("weight") * level, cap))
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    targets = targets.withColumn("part", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") - F.col("whole")).otherwise(0.0))
    targets = targets.select(F.col("source").alias("s"), "source_size", "target", "whole", "part", F.ceil(F.col("n") / GROUP_DOCS).alias("groups"))
    dealt = rows.join(small(staged(targets, "targets")), F.col("source").eqNullSafe(F.col("s")))
    dealt = dealt.withColumn("g", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), "groups"))
    group, block = Window.partitionBy("source", "g"), F.col("size") * F.col("copies")
    before = F.sum(block).over(group.orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    wanted = F.floor(F.sum(block).over(group) * F.col("part") + 0.5)
    dealt = dealt.withColumn("more", F.greatest(F.lit(0), F.least(block, wanted - F.coalesce(before, F.lit(0)))).cast("long"))
    return dealt.select("doc_id", "source", "size", "h", "copies", "source_size", "target", "whole", "more")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = TOTAL_SHARE, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target (of the source), taken, repeats (whole times), extra (words of one more) for every row.

    Null and empty texts have size 0 and are taken 0 words; a null source is a source of
    its own, the last; null ids are ordered as the text "null"; of repeated rows the
    first ones are taken once more until their share is used up; an empty table gives no
    rows. Other columns are not read.
    """
    held = _blocks(docs, id_col, text_col, source_col, total_share, epochs, seed)
    held = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    held = held.withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("more") - F.col("k") * F.col("size"))).cast("long"))
    return held.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), F.col("whole").cast("int").alias("repeats"), "extra")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = TOTAL_SHARE, epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it; what is taken in part counts if that is half of it or more.

    Rows with one id, text and source are taken alike. Reruns give the same rows.
    """
    half = (F.col("more") > 0) & (F.col("more") * 2 >= F.col("size") * F.col("copies"))
    times = _blocks(docs, id_col, text_col, source_col, total_share, epochs, seed).select(F.col("h").alias("__h"), F.col("source").alias("__s"), (F.col("whole").cast("int") + F.when(half, 1).otherwise(0)).alias("__times"))
    names = docs.columns
    rows = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at = {c: F.col(f"_{names.index(c)}") for c in (id_col, text_col, source_col)}
    key = _key(at[id_col], at[text_col], seed)
    held = rows.withColumn("__key", key).join(times.where("__times > 0"), (F.col("__key") == F.col("__h")) & at[source_col].eqNullSafe(F.col("__s")))
    return held.withColumn("__n", F.explode(F.sequence(F.lit(1), "__times"))).select(*rows.columns).toDF(*names)
