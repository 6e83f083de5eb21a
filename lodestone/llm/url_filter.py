"""Block-list filtering of captures by the list as it stood at fetch time, DataFrame functions only.

The list is a log of dated entries (a host or parent domain, added or removed). Each entry's log
becomes validity intervals; a capture is held against the entries of its host and of every parent
domain that were active on the day of its fetch.

Edge cases: a capture without a date, URL or host matches nothing; entries without name, date or
known action are ignored; when an entry is added and removed on one day, the removal wins; a
repeated addition extends nothing; repeated captures are rows of their own; very long URLs have as
many parent domains as labels; other columns are never read, whatever their names; empty tables on
either side give every capture unblocked, or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)"


def host_of(url: Column) -> Column:
    """Lower-cased host without user or port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def suffixes(host: Column) -> Column:
    """The host and its parent domains of at least two labels (the host itself if it has one)."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    ends = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(ends, lambda i: F.array_join(F.slice(parts, i, n), ".")))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(entry, valid_from, valid_to) from a log of (entry, action, dated); valid_to is exclusive, null if open.

    An entry's log has at most a row a day after the first grouping, so its window is bounded by
    the calendar and not by how often the list was published.
    """
    log = entries.filter(F.col("entry").isNotNull() & F.col("dated").isNotNull() & F.col("action").isin("add", "remove"))
    days = log.groupBy(F.lower("entry").alias("entry"), F.col("dated").cast("date").alias("dated")).agg(F.bool_or(F.col("action") == "remove").alias("off"))
    w = Window.partitionBy("entry").orderBy("dated")
    turns = days.withColumn("was_off", F.lag("off", 1, True).over(w)).filter(F.col("off") != F.col("was_off"))
    return turns.withColumn("valid_to", F.lead("dated").over(w)).filter(~F.col("off")).select("entry", F.col("dated").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetched_on") -> DataFrame:
    """One row per capture: id, host, fetched_on, n_active, matched (longest active entry), blocked.

    Only id, URL and date are read. A host that holds a third of the captures joins a handful of
    intervals; both sides of that join are plain shuffles, so AQE can split its partition.
    """
    rows = staged(captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(date_col).cast("date").alias("fetched_on"), F.monotonically_increasing_id().alias("row")), "captures")
    spans = staged(validity_intervals(entries), "intervals")
    keys = rows.filter(F.col("fetched_on").isNotNull()).select("row", "fetched_on", F.explode(suffixes(F.col("host"))).alias("entry"))
    active = (F.col("fetched_on") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    hits = keys.join(spans, "entry").filter(active)
    hits = hits.groupBy("row").agg(F.count(F.lit(1)).alias("n_active"), F.max(F.struct(F.length("entry").alias("n"), "entry")).alias("best"))
    out = rows.join(hits, "row", "left")
    return out.select(F.col("id").alias(id_col), "host", "fetched_on", F.coalesce("n_active", F.lit(0)).alias("n_active"), F.col("best.entry").alias("matched"), F.col("n_active").isNotNull().alias("blocked"))
