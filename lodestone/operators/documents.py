"""Documents as VARIANT: navigation by dotted paths, selectors, flattening to rows, pages of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def navigate(doc: Column, path: str) -> Column:
    """The part of a VARIANT at a dotted path of keys and array indices; empty segments are skipped; null if a segment leads nowhere.

    A number is a key of an object and an index of an array. Keys with both kinds of quotes cannot be named.
    """
    for segment in filter(None, path.split(".")):
        quote = '"' if "'" in segment else "'"
        steps = [F.lit(None).cast("variant") if quote in segment else F.try_variant_get(doc, f"$[{quote}{segment}{quote}]", "variant")]
        if segment.isdecimal() and segment.isascii() and int(segment) < 1 << 31:
            steps.append(F.try_variant_get(doc, f"$[{int(segment)}]", "variant"))
        doc = F.coalesce(*steps)
    return doc


def select_export(names: Column, selector: Column) -> Column:
    """struct(index, fault) of an export by its index, or by its name if just one has it."""
    n, number = F.size(names), F.when(selector.rlike(r"^\+?\d{1,18}$"), selector.try_cast("long"))
    hits = F.filter(F.transform(names, lambda x, i: F.when(x == selector, i)), lambda i: i.isNotNull())
    index = F.when(number.isNotNull(), F.when(number < n, number)).when(F.size(hits) == 1, hits[0].cast("long"))
    fault = F.when(number.isNotNull(), F.when(number >= n, "out of range")).when(F.size(hits) == 0, "unknown").when(F.size(hits) > 1, "ambiguous")
    return F.struct(index.alias("index"), fault.alias("fault"))


def first_property(properties: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """Of each key the value of the first property of that name with array_index 0."""
    return properties.filter((F.col("name") == name) & (F.col("array_index") == 0)).groupBy(key).agg(F.min_by("value", order).alias("value"))


def flatten(docs: DataFrame, key: str, doc: str, expanded: Column | None = None, depth: int = 8, cap: int | None = None) -> DataFrame:
    """Rows (key, path, label, depth, kind, value) of the VARIANTs in doc: a row a node, as deep as `depth`.

    path: array of steps from the root, each a sortable place and a label. expanded (over key, path,
    label, depth) tells whose children are shown; all if it is not given. With a cap, cap + 1 rows
    of each key at most, in order, so that what is left out can be told.
    """
    kind = F.regexp_extract(F.schema_of_variant("node"), "^[A-Z]+", 0)
    level = docs.select(key, F.array().cast("array<struct<place:int,label:string>>").alias("path"), F.lit("").alias("label"), F.lit(0).alias("depth"), F.col(doc).alias("node"))
    out = None
    for d in range(depth + 1):
        rows = level.withColumn("kind", F.coalesce(kind, F.lit("NULL")))
        inner = F.col("kind").isin("OBJECT", "ARRAY")
        # containers by their number of children
        n = F.coalesce(F.json_array_length(F.to_json("node")), F.size(F.json_object_keys(F.to_json("node"))))
        value = F.when(inner, F.concat(F.lit("["), n.cast("string"), F.lit("]"))).otherwise(F.to_json("node"))
        part = rows.select(key, "path", "label", "depth", "kind", value.alias("value"))
        out = part if out is None else out.unionByName(part)
        if d < depth:
            open_ = rows.filter(inner if expanded is None else inner & expanded)
            child = docs.sparkSession.sql("SELECT r.*, c.pos, c.key AS name, c.value AS child FROM {rows} r, LATERAL variant_explode(r.node) c", rows=open_)
            label = F.coalesce(F.col("name"), F.col("pos").cast("string"))
            level = child.select(key, F.concat("path", F.array(F.struct(F.col("pos").alias("place"), label.alias("label")))).alias("path"), label.alias("label"), (F.col("depth") + 1).alias("depth"), F.col("child").alias("node"))
    if cap is None:
        return out
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("path"))).filter(F.col("_n") <= cap + 1).drop("_n")


def hex_rows(data: Column) -> Column:
    """array<struct(offset, bytes)>: rows of 16 bytes, the last one shorter."""
    n = F.ceil(F.length(data) / 16).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct((i * 16).alias("offset"), F.substring(data, i * 16 + 1, F.lit(16)).alias("bytes")))
