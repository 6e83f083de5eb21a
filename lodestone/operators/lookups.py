"""Lookups as joins: names, references, as-of, ranges, layers, cross-checks, closures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType


def resolve_name(name: Column, index: Column, number: Column) -> Column:
    """The pool's name, "_n" appended for number n + 1, or a mark for an index outside the pool."""
    return F.when(name.isNull(), F.concat(F.lit("<oob:"), index.cast("string"), F.lit(">"))).when(number > 0, F.concat(name, F.lit("_"), (number - 1).cast("string"))).otherwise(name)


def resolve_names(refs: DataFrame, pool: DataFrame, index: str, number: str, out: str = "resolved") -> DataFrame:
    """refs with the name of each (index, number) in pool (idx, name)."""
    both = refs.join(pool.select(F.col("idx").alias("_idx"), F.col("name").alias("_name")), F.col(index) == F.col("_idx"), "left")
    return both.withColumn(out, resolve_name(F.col("_name"), F.col(index), F.col(number))).drop("_idx", "_name")


def strict_names(refs: DataFrame, pool: DataFrame, index: str, number: str, out: str = "resolved") -> DataFrame:
    """As resolve_names; an index outside the pool is an error when its row is read."""
    named = resolve_names(refs, pool, index, number, "_text")
    missing = F.col("_text").isNull() | F.startswith("_text", F.lit("<oob:"))
    return named.withColumn(out, F.when(missing, F.raise_error(F.concat(F.lit("name index "), F.coalesce(F.col(index).cast("string"), F.lit("null")), F.lit(" is outside the pool")))).otherwise(F.col("_text"))).drop("_text")


def children_of(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """nodes (id, ...) that have children (child, parent), with these in order."""
    lists = children.groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list("child")).alias("children"))
    return nodes.join(lists, "id")


def resolve_refs(refs: DataFrame, ref: str, imports: DataFrame, exports: DataFrame, out: str = "target") -> DataFrame:
    """Signed references: 0 is Null, n > 0 the export n - 1, n < 0 the import -n - 1; tables are (idx, name)."""
    r = F.col(ref)
    i = imports.select(F.col("idx").alias("_i"), F.col("name").alias("_in"))
    e = exports.select(F.col("idx").alias("_e"), F.col("name").alias("_en"))
    both = refs.join(i, (-r - 1) == F.col("_i"), "left").join(e, (r - 1) == F.col("_e"), "left")
    hit = F.when(r == 0, "Null").when(r > 0, F.col("_en")).otherwise(F.col("_in"))
    return both.withColumn(out, F.coalesce(hit, F.concat(F.lit("<oob:"), r.cast("string"), F.lit(">")))).drop("_i", "_in", "_e", "_en")


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_order: Sequence[str], value: str, span: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with value of the last row of right at or before left_at, per key; null where there is none, and for null keys.

    right_order starts with right's time and ends with a unique column. The two are laid over each
    other by key and span of time (a rising function of it; unless given months, or one span for numbers) and the last value
    is carried forward inside; what a span inherits comes from the last values of the spans before.
    No pairs are made, and a key with most of the rows is as many tasks as it has spans.
    """
    at, timed = right_order[0], isinstance(left.schema[left_at].dataType, DateType | TimestampType | TimestampNTZType)
    span = span or (lambda c: F.date_trunc("month", c) if timed else F.lit(0))
    ties = [F.col(c) for c in right_order[1:]]
    r = right.filter(F.col(key).isNotNull()).select(F.col(key), F.col(at).alias("_at"), span(F.col(at)).alias("_span"), F.lit(0).alias("_side"), F.struct(*ties).alias("_tie"), F.struct(F.col(value).alias("v")).alias("_v"))
    lefts = left.select(F.col(key), F.col(left_at).alias("_at"), span(F.col(left_at)).alias("_span"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), F.struct(*left.columns).alias("_row"))
    both = r.withColumn("_row", F.lit(None).cast(lefts.schema["_row"].dataType)).unionByName(lefts)
    w = Window.partitionBy(key, "_span").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select(key, "_span", "_row", "_last")
    ends = both.groupBy(key, "_span").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct("_at", "_tie"))).alias("_end"), F.bool_or(F.col("_side") == 1).alias("_asks"))
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), "_asks", F.last("_end", ignorenulls=True).over(before).alias("_carry")).filter("_asks")
    out = inside.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_span").eqNullSafe(F.col("_s")))
    return out.select("_row.*", F.coalesce("_last", "_carry")["v"].alias(value))


def range_cells(ranges: DataFrame, width: int) -> DataFrame:
    """The ranges cut at cells of `width`: (_cell, lo, hi, ordinal), of equal pieces the one of the last ordinal, as no other can own a value."""
    cells = ranges.filter("lo < hi").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    lo, hi = F.greatest("lo", F.col("_cell") * width), F.least("hi", (F.col("_cell") + 1) * width)
    return cells.groupBy("_cell", lo.alias("lo"), hi.alias("hi")).agg(F.max("ordinal").alias("ordinal"))


def range_segments(ranges: DataFrame, width: int) -> DataFrame:
    """Disjoint (_cell, lo, hi, owner) of ranges (lo, hi, ordinal): what of each cell has one owner, the last ordinal that covers it."""
    cells = range_cells(ranges, width)
    points = cells.select("_cell", F.explode(F.array("lo", "hi")).alias("at")).distinct()
    cuts = points.withColumn("end", F.lead("at").over(Window.partitionBy("_cell").orderBy("at"))).filter("end IS NOT NULL")
    covered = cuts.join(cells, "_cell").filter("lo <= at AND end <= hi").groupBy("_cell", "at", "end").agg(F.max("ordinal").alias("owner"))
    return covered.select("_cell", F.col("at").alias("lo"), F.col("end").alias("hi"), "owner")


def range_owner(values: DataFrame, value: str, ranges: DataFrame, width: int) -> DataFrame:
    """values with owner: of the half-open ranges (lo, hi, ordinal) that hold value, the one of the last ordinal.

    Ranges are cut into cells of `width` and there into segments of one owner, so the join is an
    equality of cells in which a value meets one segment at most.
    """
    segments = range_segments(ranges, width)
    rows = values.withColumn("_at", F.floor(F.col(value) / width))
    inside = (F.col("_at") == F.col("_cell")) & (F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))
    return rows.join(segments, inside, "left").drop("_at", "_cell", "lo", "hi")


def layered(local: DataFrame, registry: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of local, then the first row of each registry key that local lacks; with layer."""
    other = registry.join(local.select(key), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*[c for c in registry.columns if c != key]), F.col(order)).alias("r"))
    other = other.select(key, *[F.col(f"r.{c}").alias(c) for c in registry.columns if c != key])
    return local.select(*registry.columns, F.lit("local").alias("layer")).unionByName(other.select(*registry.columns, F.lit("registry").alias("layer")))


def cross_check(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys on which two (key, value) tables disagree: missing_left, missing_right or mismatch."""
    x = left.select(F.col(key), F.col(value).alias("l"), F.lit(True).alias("has_l"))
    y = right.select(F.col(key), F.col(value).alias("r"), F.lit(True).alias("has_r"))
    both = x.join(y, key, "full")
    fault = F.when(F.col("has_l").isNull(), "missing_left").when(F.col("has_r").isNull(), "missing_right").when(~F.col("l").eqNullSafe(F.col("r")), "mismatch")
    return both.select(key, fault.alias("fault")).filter("fault IS NOT NULL")


def closure(parents: DataFrame, most: int = 64) -> DataFrame:
    """(root, node, depth, truncated) of every chain child -> parent of (node, parent), of at most `most` nodes.

    A step that would return to a node already in the chain ends it. truncated: the chain of this
    root has `most` nodes and the last one has a parent still. The session's limit of rows that a
    recursion may make is lifted, as `most` bounds its steps.
    """
    spark = parents.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    chains = spark.sql(
        f"""
        WITH RECURSIVE chain(root, node, depth, seen) AS (
          SELECT node, node, 0, array(node) FROM {{p}}
          UNION ALL
          SELECT c.root, p.parent, c.depth + 1, array_append(c.seen, p.parent)
          FROM chain c JOIN {{p}} p ON c.node = p.node
          WHERE p.parent IS NOT NULL AND c.depth < {most - 1} AND NOT array_contains(c.seen, p.parent))
        SELECT root, node, depth FROM chain""",
        p=parents.select("node", "parent"),
    )
    more = parents.filter("parent IS NOT NULL").select("node").distinct()
    cut = chains.filter(F.col("depth") == most - 1).join(more, "node").select("root", F.lit(True).alias("cut")).distinct()
    return chains.join(cut, "root", "left").select("root", "node", "depth", F.coalesce("cut", F.lit(False)).alias("truncated"))
