"""Who handles what: readers by class, handlers by registration, formats, detected profiles, levels that fit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def readers(exports: DataFrame, table: DataFrame, name: str, generic: str = "generic") -> DataFrame:
    """exports with the reader of their class in table (class, reader), or the generic one."""
    t = table.select(F.col("class").alias("_c"), F.col("reader").alias("_r"))
    return exports.join(t, F.col(name) == F.col("_c"), "left").withColumn("reader", F.coalesce("_r", F.lit(generic))).drop("_c", "_r")


def first_handlers(assets: DataFrame, handlers: DataFrame, key: Sequence[str], supports: Column, variant: str = "variant", wanted: str | None = None) -> DataFrame:
    """key and the first registered handler of each asset that supports it; with wanted, of those that write that extension column.

    handlers: (variant, ext, ord, handler and what supports reads). An aggregate over registration
    order, so that a variant with most of the assets combines in the map tasks.
    """
    fits = supports if wanted is None else supports & (F.col("ext") == F.col(wanted))
    both = assets.join(handlers.withColumnRenamed("variant", "_v"), F.col(variant) == F.col("_v")).filter(fits)
    return both.groupBy(*key).agg(F.min_by(F.struct("handler", "ext"), "ord").alias("h")).select(*key, "h.handler", "h.ext")


def first_exportable(handled: DataFrame, package: str, index: str) -> DataFrame:
    """Of each package the handled payload of the least index."""
    rest = [c for c in handled.columns if c != package]
    return handled.groupBy(package).agg(F.min_by(F.struct(*rest), index).alias("r")).select(package, "r.*")


def formats(assets: DataFrame, handlers: DataFrame, key: Sequence[str], supports: Column, variant: str = "variant") -> DataFrame:
    """Each asset's extensions once, with the place of the first handler that writes them."""
    both = assets.join(handlers.withColumnRenamed("variant", "_v"), F.col(variant) == F.col("_v")).filter(supports)
    return both.groupBy(*key, "ext").agg(F.min("ord").alias("ord"))


def detected(local: DataFrame, registry: DataFrame, key: str, order: str, matches: Column) -> DataFrame:
    """Profiles whose rules match: the local ones, and the first registry profile of each id that no local profile has, matching or not."""
    shown = registry.join(local.select(key), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*[c for c in registry.columns if c != key]), order).alias("r")).select(key, "r.*")
    names = [c for c in registry.columns if c in local.columns]
    pick = lambda df, layer: df.filter(F.coalesce(matches, F.lit(False))).select(*names, F.lit(layer).alias("layer"))
    return pick(local, "local").unionByName(pick(shown, "registry"))


def best_level(levels: DataFrame, key: str, level: str, size: Column, cap: int) -> DataFrame:
    """Of each texture the first level (the highest resolution) whose bytes are within the cap; none if no level is."""
    return levels.groupBy(key).agg(F.min(F.when(size <= cap, F.col(level))).alias("level"))


def containing_archive(assets: DataFrame, entries: DataFrame, path: str, source: str) -> DataFrame:
    """assets with the one archive that holds their path, or the fault: in none, or in several."""
    homes = entries.groupBy(F.col(path).alias("_p")).agg(F.count_distinct(source).alias("_n"), F.min(source).alias("_s"))
    both = assets.join(homes, F.col(path) == F.col("_p"), "left")
    fault = F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "ambiguous")
    return both.withColumns({"archive": F.when(F.col("_n") == 1, F.col("_s")), "fault": fault}).drop("_p", "_n", "_s")
