"""Sinks: data tables as CSV and JSON, entry listings, extraction summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import shapes

#: Fixed value: version of the JSON listings.
SCHEMA_VERSION = 1


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """RFC 4180 with a header and LF; null is an empty field, an empty string a quoted one."""
    df.write.mode(mode).csv(path, header=True, escape='"', emptyValue='""', nullValue="", lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def data_table(cells: DataFrame, row: str, name: str, index: str, value: str, order: Sequence[str]) -> DataFrame:
    """Wide table of property cells: column Name, then name or name[i] as they first appear, the first value of each."""
    headed = cells.withColumn("_column", paths.column_header(F.col(name), F.col(index)))
    return shapes.pivot_first(headed, row, "_column", value, order).withColumnRenamed(row, "Name")


def data_table_json(cells: DataFrame, table: str, row: str, name: str, value: str, order: Sequence[str], row_struct: Column | None = None, class_properties: Column | None = None) -> DataFrame:
    """(table, document): rows with their cells in order, all of them; row_struct and class_properties (of a table's first cell) before and behind them."""
    cell = F.struct(*order, F.struct(F.col(name).alias("name"), F.col(value).alias("value")).alias("c"))
    rows = cells.groupBy(table, row).agg(F.array_sort(F.collect_list(cell)).alias("c"), F.min(F.struct(*order)).alias("o"))
    one = F.struct("o", F.struct(F.col(row).alias("name"), F.transform("c", lambda x: x["c"]).alias("cells")).alias("r"))
    tables = rows.groupBy(table).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["r"]).alias("rows"))
    extra = [(n, c) for n, c in (("row_struct", row_struct), ("class_properties", class_properties)) if c is not None]
    if extra:
        firsts = cells.groupBy(table).agg(*[F.min_by(c, F.struct(*order)).alias(n) for n, c in extra])
        tables = tables.join(firsts, table)
    names = [n for n in ("row_struct", "rows", "class_properties") if n in tables.columns]
    return tables.select(table, F.to_json(F.struct(*names)).alias("document"))


def listing(entries: DataFrame) -> DataFrame:
    """Entries as JSON lines, each with the listing's version; a file of one array would not be splittable."""
    return entries.select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), *entries.columns)).alias("value"))


def listing_document(entries: DataFrame, order: Sequence[str]) -> DataFrame:
    """All entries as one JSON document with the listing's version; for listings that one reader takes whole."""
    all_ = F.array_sort(F.collect_list(F.struct(*order, F.struct(*entries.columns).alias("e"))))
    return entries.agg(all_.alias("a")).select(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.transform("a", lambda x: x["e"]).alias("entries"))).alias("document"))


def write_listing(entries: DataFrame, path: str, mode: str = "errorifexists") -> None:
    listing(entries).write.mode(mode).text(path)


def failures(outcomes: DataFrame) -> DataFrame:
    """All failures by entry, a row each."""
    return outcomes.filter("kind = 'failed'").select("entry", "reason").orderBy("entry")


def summary(outcomes: DataFrame) -> DataFrame:
    """One row: counts by kind, and all failures by entry. The row is as long as there are failures; `failures` gives them as rows."""
    kinds = ("converted", "raw_copied", "skipped_companion", "failed")
    failed = F.array_sort(F.collect_list(F.when(F.col("kind") == "failed", F.struct("entry", "reason"))))
    both = outcomes.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], failed.alias("failures"))
    return both.select(F.lit(SCHEMA_VERSION).alias("schema_version"), F.struct(*kinds).alias("counts"), "failures")
