"""The entry catalog: compound search, multi-archive union, override, summaries, integrity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import paths


def search(entries: DataFrame, ext: Sequence[str] = (), glob: str | None = None, name: str | None = None, regex: str | None = None, min_size: str | None = None, max_size: str | None = None) -> DataFrame:
    """Entries (path, size) that meet all of the given predicates; none given keeps all.

    ext: extensions without dot; glob matches the whole path, name the last component, regex
    anywhere; sizes are inclusive.
    """
    lo, hi = (paths.parse_size(s) if s is not None else None for s in (min_size, max_size))
    if lo is not None and hi is not None and lo > hi:
        raise ValueError(f"least size {min_size} is over the largest {max_size}")
    if regex is not None:
        _check_regex(entries, regex)
    p, tests = F.col("path"), []
    if ext:
        tests.append(F.coalesce(paths.extension(p).isin(*[e.lower() for e in ext]), F.lit(False)))
    if glob is not None:
        tests.append(p.rlike(paths.glob_regex(glob)))
    if name is not None:
        tests.append(paths.basename(p).rlike(paths.glob_regex(name)))
    if regex is not None:
        tests.append(p.rlike(regex))
    if lo is not None:
        tests.append(F.col("size") >= lo)
    if hi is not None:
        tests.append(F.col("size") <= hi)
    return entries.filter(reduce(and_, tests)) if tests else entries


def _check_regex(df: DataFrame, regex: str) -> None:
    """ValueError now for what would fail in the job: the pattern is one of Java's."""
    try:
        df.sparkSession._jvm.java.util.regex.Pattern.compile(regex)
    except (Py4JJavaError, IllegalArgumentException) as x:
        raise ValueError(f"not a pattern: {regex!r}") from x


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Entries of all sources, with their source."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("source"), *df.columns) for k, df in sorted(sources.items())])


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by a unique order column, and how many the key had.

    An aggregate and not a window: a key with most of the rows combines in the map tasks.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"), F.count(F.lit(1)).alias("n_rows"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], "n_rows")


def mount_override(rows: DataFrame, path: str, source: str) -> DataFrame:
    """All rows whose source is the last (highest) that has their path."""
    top = rows.groupBy(path).agg(F.max(source).alias("_top"))
    return rows.join(top, path).filter(F.col(source) == F.col("_top")).drop("_top")


def outcome_summary(outcomes: DataFrame, key: str, kind: str, kinds: Sequence[str], failed: str = "failed") -> DataFrame:
    """Counts by kind for each key, and whether any failed."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    return outcomes.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *counts, F.coalesce(F.bool_or(F.col(kind) == failed), F.lit(False)).alias("had_failures"))


def verify_outcome(content: Column, claimed: Column, archive_claims: Column) -> Column:
    """verified, mismatch, stripped or skipped of one entry against its claimed SHA-1 (hex).

    A claim of zeros is none: skipped, unless the archive has hashes, then the claim was stripped.
    """
    zero = (claimed == "0" * 40) | claimed.isNull()
    return F.when(zero & archive_claims, "stripped").when(zero, "skipped").when(F.sha1(content) == claimed, "verified").otherwise("mismatch")


def block_order(blocks: DataFrame, key: str, order: Sequence[str], start: str, end: str) -> DataFrame:
    """blocks with in_order: whether a block starts at or after its predecessor's end."""
    w = Window.partitionBy(key).orderBy(*order)
    return blocks.withColumn("in_order", F.coalesce(F.col(start) >= F.lag(end).over(w), F.lit(True)))


def running_budget(rows: DataFrame, key: str, order: Sequence[str], amount: str, budget: int) -> DataFrame:
    """rows with running (sum so far in the key) and accepted (running within budget)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(amount).over(w)).withColumn("accepted", F.col("running") <= budget)
