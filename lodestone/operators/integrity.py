"""Whole archives: what their index claims, the worst of its regions, hashes over blocks, sizes that add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claims_integrity(index_hash: Column) -> Column:
    """Whether the index's own hash is there at all: not all zeros."""
    return index_hash.isNotNull() & (index_hash != "0" * 40)


def worst_of(main: Column, *regions: Column) -> Column:
    """The first outcome that is not verified, of the main index and then of the regions that are there; else verified."""
    return F.coalesce(*[F.when(r.isNotNull() & ~r.isin("verified", "not_present"), r) for r in (main, *regions)], F.lit("verified"))


def fully_verified(main: Column, regions: Sequence[Column], verified: Column, skipped: Column) -> Column:
    """The index and its regions verified or absent, no entry skipped, and one verified at least."""
    out = (main == "verified") & (skipped == 0) & (verified > 0)
    for r in regions:
        out = out & F.coalesce(r.isin("verified", "not_present"), F.lit(True))
    return out


def hash_of_blocks(blocks: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """SHA-1 of each key's blocks end to end, and how many there are."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d"))))
    joined = F.aggregate(F.col("_b"), F.unhex(F.lit("")), lambda a, x: F.concat(a, x["d"]))
    return blocks.groupBy(key).agg(parts.alias("_b")).select(key, F.sha1(joined).alias("sha1"), F.size("_b").cast("long").alias("n_blocks"))


def cumulative_size(blocks: DataFrame, key: str, order: Sequence[str], size: str, declared: str) -> DataFrame:
    """blocks with written (bytes so far) and fault: overrun where they pass the declared size, short at the last block if they do not reach it."""
    w = Window.partitionBy(key).orderBy(*order)
    written = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead(F.lit(True)).over(w).isNull()
    return blocks.withColumns({"written": written, "_last": last}).withColumn("fault", F.when(F.col("written") > F.col(declared), "overrun").when(F.col("_last") & (F.col("written") < F.col(declared)), "short")).drop("_last")


def duplicates(entries: DataFrame, key: str, name: str) -> DataFrame:
    """Of each key (an archive): rows, repeated names, and the five first of these by name."""
    per = entries.groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))
    # five names a key leave each task: the array is cut as it grows
    first = F.slice(F.array_sort(F.collect_set(F.when(F.col("place") <= 5, F.col(name)))), 1, 5)
    w = Window.partitionBy(key).orderBy(name)
    again = per.filter("n > 1").withColumn("place", F.row_number().over(w)).filter("place <= 5").groupBy(key).agg(first.alias("sample"))
    sums = per.groupBy(key).agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"))
    return sums.join(again, key, "left").withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))
