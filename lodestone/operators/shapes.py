"""Reshaping: column union and pivot, ordered concatenation, buckets, bounds, trees, rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def column_order(cells: DataFrame, name: str, order: Sequence[str], most: int = 10_000) -> list[str]:
    """Names in the order in which they first appear. More than `most` are an error, as no table is that wide."""
    seen = cells.groupBy(name).agg(F.min(F.struct(*order)).alias("at")).orderBy("at").limit(most + 1).collect()
    if len(seen) > most:
        raise ValueError(f"more than {most} columns")
    return [r[name] for r in seen]


def pivot_first(cells: DataFrame, row: str, name: str, value: str, order: Sequence[str]) -> DataFrame:
    """Wide table of (row, name, value): the first value of each cell, columns as they first appear, null where missing."""
    names = column_order(cells, name, order)
    firsts = [F.min_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.struct(*order))).alias(n) for n in names]
    return cells.groupBy(row).agg(*firsts)


def joined_parts(parts: DataFrame, key: str, order: str, text: str, size: int | str, sep: str = "") -> DataFrame:
    """Each key's texts, cut to size (a number, or the column of each part's own), end to end by order; the parts' number and the saturating sum of sizes, each at most its text's length and at least 0."""
    n = F.greatest(F.coalesce(F.col(size) if isinstance(size, str) else F.lit(size), F.lit(0)).cast("long"), F.lit(0))
    n = F.least(n, F.coalesce(F.length(text), F.lit(0))).cast("int")
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.substring(F.col(text), F.lit(1), n).alias("t"))))
    length = F.coalesce(F.try_sum(n.cast("long")), F.lit(2**63 - 1))
    return parts.groupBy(key).agg(items.alias("_i"), length.alias("length")).select(key, F.array_join(F.transform("_i", lambda x: x["t"]), sep).alias("joined"), F.size("_i").cast("long").alias("n_parts"), "length")


def numbered(rows: DataFrame, key: str, order: Sequence[str], part: Column) -> DataFrame:
    """rows with _at, their place (from 0) in the order of their key, and _n, the key's rows.

    part is a rising function of the order: places are counted inside (key, part) and shifted by
    the sizes of the parts before, so a key with most of the rows is as many tasks as it has parts.
    """
    rows = rows.withColumn("_part", part)
    inside = Window.partitionBy(key, "_part").orderBy(*order)
    placed = rows.withColumn("_in", F.row_number().over(inside) - 1)
    sizes = rows.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    parts = Window.partitionBy("_k")
    shift = F.coalesce(F.sum("_c").over(parts.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"_shift": shift, "_n": F.sum("_c").over(parts)})
    both = placed.join(sizes, F.col(key).eqNullSafe(F.col("_k")) & F.col("_part").eqNullSafe(F.col("_p")))
    return both.withColumn("_at", F.col("_in") + F.col("_shift")).drop("_part", "_in", "_k", "_p", "_c", "_shift")


def even_buckets(samples: DataFrame, key: str, order: Sequence[str], value: str, columns: int, part: Column | None = None) -> DataFrame:
    """Least and largest value of each of `columns` even buckets of a key's ordered samples (fewer if the samples are); part as for numbered."""
    rows = numbered(samples, key, order, F.lit(0) if part is None else part)
    bucket = F.floor(F.col("_at") * F.least("_n", F.lit(columns)) / F.col("_n")).cast("long")
    return rows.groupBy(key, bucket.alias("bucket")).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def waveform(frames: DataFrame, key: str, frame: str, channels: Sequence[str], columns: int) -> DataFrame:
    """Least and largest mean of the channels in each of `columns` even buckets of a key's frames, numbered from 0.

    The frames' number is an aggregate of its own, so a key with most of the rows is no task of its own.
    """
    mean = sum((F.col(c) for c in channels[1:]), F.col(channels[0])) / len(channels)
    n = frames.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    bucket = F.floor(F.col(frame) * F.least("_n", F.lit(columns)) / F.col("_n"))
    return frames.select(key, F.col(frame), mean.alias("_mean")).join(n, key).groupBy(key, bucket.alias("bucket")).agg(F.min("_mean").alias("low"), F.max("_mean").alias("high"))


def component_bounds(rows: DataFrame, vec: str) -> DataFrame:
    """Least and largest of each component (dim from 0)."""
    return rows.select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def path_nodes(entries: DataFrame, path: str = "path") -> DataFrame:
    """Every file and directory of the paths once: node, parent, label, depth, is_file, n_files below or at it."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size("parts")
    rows = entries.select(path).distinct().withColumn("parts", parts).filter(n > 0)
    rows = rows.select("parts", F.explode(F.sequence(F.lit(1), n)).alias("depth"))
    pre = lambda d: F.array_join(F.slice("parts", F.lit(1), d), "/")
    nodes = rows.select(pre(F.col("depth")).alias("node"), F.when(F.col("depth") > 1, pre(F.col("depth") - 1)).alias("parent"), F.element_at("parts", F.col("depth")).alias("label"), "depth", (F.col("depth") == n).alias("is_file"))
    return nodes.groupBy("node", "parent", "label", "depth").agg(F.bool_and("is_file").alias("is_file"), F.count(F.lit(1)).alias("n_files"))


def with_matches(nodes: DataFrame, text: str) -> DataFrame:
    """Nodes whose label holds text, any case, and all their ancestors."""
    hits = nodes.filter(F.contains(F.lower("label"), F.lit(text.lower()))).select(F.split("node", "/").alias("p"))
    keep = hits.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), "/"))).alias("node")).distinct()
    return nodes.join(keep, "node", "left_semi")


def dirs_first(nodes: DataFrame) -> DataFrame:
    """nodes with place: the order among siblings, directories before files, then by label. A folder is counted in parts by the first two letters of its labels."""
    part = F.concat(F.when(F.col("is_file"), "1").otherwise("0"), F.left("label", F.lit(2)))
    rows = numbered(nodes, "parent", ["is_file", "label"], part)
    return rows.withColumn("place", (F.col("_at") + 1).cast("int")).drop("_at", "_n")


def shown(nodes: DataFrame, expanded: Sequence[str]) -> DataFrame:
    """The nodes of path_nodes that a tree shows when the given folders are open: those whose ancestors all are, in order of the whole path with folders first.

    place: one string that sorts so, of a mark and a label for each step.
    """
    parts = F.split("node", "/")
    ups = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    open_ = F.array(*map(F.lit, expanded)) if expanded else F.array().cast("array<string>")
    seen = (F.col("depth") == 1) | F.forall(F.when(F.col("depth") > 1, ups).otherwise(F.array().cast("array<string>")), lambda u: F.array_contains(open_, u))
    marks = F.transform(parts, lambda x, i: F.concat(F.when((i == F.size(parts) - 1) & F.col("is_file"), "1").otherwise("0"), x))
    return nodes.filter(seen).withColumn("place", F.array_join(marks, "\x01")).orderBy("place")


def rules_hold(tests: Sequence[Column]) -> Column:
    """All tests, and at least one: without rules nothing is detected."""
    out = F.lit(bool(tests))
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def last_rows(log: DataFrame, seq: str, n: int = 2000) -> DataFrame:
    """The n rows of the highest seq: what a ring buffer of n still holds."""
    return log.orderBy(F.desc(seq)).limit(n)


def stale(now: Column, fetched: Column, hours: int) -> Column:
    """More than `hours` since fetched, in epoch seconds; a fetch in the future is fresh."""
    return F.greatest(now - fetched, F.lit(0).cast("long")) > hours * 3600
