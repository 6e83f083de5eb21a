"""Schemas of classes: slots over an inheritance chain, enums, versions, keys, and the slots a header names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookups import closure

#: Most slots that all classes together may have.
MOST_SLOTS = 4_194_304


def flattened_slots(classes: DataFrame, properties: DataFrame, most: int = MOST_SLOTS) -> DataFrame:
    """Every property of every class and its ancestors, with its absolute slot: (class, slot, from_class, depth, schema_index, name, truncated).

    classes: (class, super, prop_count); properties: (class, schema_index, name). A slot is the
    property's own index behind all slots of the classes before its own, the class itself first;
    it stops at 65,535. truncated: the chain went on past 64 classes. More than `most` slots are an error.
    """
    chain = closure(classes.select(F.col("class").alias("node"), F.when(F.col("super") != "", F.col("super")).alias("parent")))
    counted = chain.join(classes.select(F.col("class").alias("node"), F.col("prop_count").cast("long").alias("n")), "node")
    before = Window.partitionBy("root").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    sizes = properties.groupBy(F.col("class").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    total = chain.join(sizes, "node").agg(F.sum("n")).first()[0] or 0
    if total > most:
        raise ValueError(f"{total} slots are more than {most}")
    slot = F.least(F.col("offset") + F.col("schema_index"), F.lit(65535)).alias("slot")
    rows = offsets.join(properties.withColumnRenamed("class", "node"), "node")
    return rows.select(F.col("root").alias("class"), slot, F.col("node").alias("from_class"), "depth", "schema_index", "name", "truncated")


def enum_names(values: DataFrame, enums: DataFrame, enum: str, ordinal: str, out: str = "label") -> DataFrame:
    """values with the name of (enum, ordinal) in enums (enum, ordinal, name), or the ordinal where enums has none."""
    names = enums.select(F.col("enum").alias("_e"), F.col("ordinal").alias("_o"), F.col("name").alias("_n"))
    both = values.join(names, (F.col(enum) == F.col("_e")) & (F.col(ordinal) == F.col("_o")), "left")
    return both.withColumn(out, F.coalesce("_n", F.col(ordinal).cast("string"))).drop("_e", "_o", "_n")


def keys_by_guid(archives: DataFrame, keys: DataFrame, guid: str, zero: str) -> DataFrame:
    """archives with the key of their GUID in keys (guid, key), else the one of the all-zero GUID."""
    own = keys.select(F.col("guid").alias("_g"), F.col("key").alias("_own"))
    rest = keys.filter(F.col("guid") == zero).agg(F.min("key").alias("_zero"))
    both = archives.join(own, F.col(guid) == F.col("_g"), "left").join(F.broadcast(rest))  # one row
    return both.withColumn("key", F.coalesce("_own", "_zero")).drop("_g", "_own", "_zero")


def fragment_ranges(headers: DataFrame, key: str, order: Sequence[str], packed: str) -> DataFrame:
    """headers with (first, end, has_zeros, zero_base) of each 16-bit fragment: 7 bits of slots skipped, a flag of zeros, one of the end, 7 bits of slots that follow."""
    p = F.col(packed)
    skip, n, zeros = p.bitwiseAND(0x7F), F.shiftright(p, 9).bitwiseAND(0x7F), p.bitwiseAND(0x80) != 0
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end, zero_end = F.sum(skip + n).over(w), F.sum(F.when(zeros, n).otherwise(0)).over(w)
    return headers.withColumns({"first": F.least(end - n, F.lit(65535)), "end": F.least(end, F.lit(65535)), "has_zeros": zeros, "zero_base": F.when(zeros, zero_end - n).otherwise(0)})


def slot_present(slots: DataFrame, ranges: DataFrame, masks: DataFrame, key: str, slot: str) -> DataFrame:
    """slots with present: a fragment of their key's header holds the slot, and its bit of the mask (key, mask) is not set; bits past the mask count as set."""
    inside = (F.col(slot) >= F.col("first")) & (F.col(slot) < F.col("end"))
    hit = slots.join(ranges.select(F.col(key).alias("_k"), "first", "end", "has_zeros", "zero_base"), (F.col(key) == F.col("_k")) & inside, "left")
    hit = hit.join(masks.select(F.col(key).alias("_m"), F.col("mask").alias("_mask")), F.col(key) == F.col("_m"), "left")
    bit = F.col("zero_base") + F.col(slot) - F.col("first")
    octet = F.conv(F.hex(F.substring(F.col("_mask"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    clear = F.coalesce(F.when(octet.isNotNull(), F.floor(octet / F.pow(F.lit(2), bit % 8)) % 2 == 0), F.lit(False))
    return hit.withColumn("present", F.col("first").isNotNull() & (~F.col("has_zeros") | clear)).drop("_k", "_m", "_mask", "first", "end", "has_zeros", "zero_base")


def bucket_of(fences: Column, tile: Column, chunks: Column) -> Column:
    """The chunk whose range between two fences holds the tile; the last one below the first fence and beyond the last."""
    below, last = F.size(F.filter(fences, lambda f: f <= tile)), F.greatest(chunks - 1, F.lit(0))
    return F.when(below == 0, last).otherwise(F.least(below - 1, last))


def global_bone(bone_map: Column, local: Column, bones: Column) -> Column:
    """The skeleton's bone of a section's local one; null outside the map or the skeleton."""
    hit = F.when(local >= 0, F.get(bone_map, local.cast("int")))
    return F.when((hit >= 0) & (hit < bones), hit)
