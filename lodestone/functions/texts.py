"""Versions, hexadecimal text, GUIDs, log lines and cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of a log from the gravest on.
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")
#: Kinds of property whose cell is their plain text.
PLAIN = ("Bool", "Byte", "Int8", "Int16", "Int", "Int64", "UInt16", "UInt32", "UInt64", "Float", "Double", "Str", "Name")
ZERO_GUID = "0" * 32


def version(text: Column) -> Column:
    """struct(major, minor, patch) of "UE4.27", "5.3.2" and the like; null for anything else or parts of more than 32 bits."""
    t, shape = F.trim(text), r"^(?:[Uu][Ee])?\s*\+?(\d+)\.\+?(\d+)(?:\.\+?(\d+))?$"
    part = lambda i: F.regexp_extract(t, shape, i).try_cast("decimal(20,0)")
    small = lambda i: (F.length(F.regexp_extract(t, shape, i)) <= 20) & (F.coalesce(part(i), F.lit(0)) < 1 << 32)
    return F.when(t.rlike(shape) & small(1) & small(2) & small(3), F.struct(*[part(i).cast("long").alias(n) for i, n in enumerate(("major", "minor", "patch"), 1)]))


def at_least(v: Column, major: int, minor: int) -> Column:
    return (v["major"] > major) | ((v["major"] == major) & (v["minor"] >= minor))


def engine_gate(verdict: Column, hint: Column, major: int, minor: int) -> Column:
    """What the data asserts or denies; where it leaves the matter open, whether the hinted version is at least that."""
    return F.when(verdict == "asserts", True).when(verdict == "denies", False).otherwise(F.coalesce(at_least(hint, major, minor), F.lit(False)))


def hex_bytes(text: Column) -> Column:
    """Bytes of an even number of hexadecimal digits; null for anything else and for no digits."""
    return F.when(text.rlike("^(?:[0-9A-Fa-f]{2})+$"), F.unhex(text))


def guid_hex(text: Column) -> Column:
    """32 digits, lower case, of a GUID with or without 0x; null for anything else."""
    bare = F.regexp_replace(text, "^0[xX]", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{32}$"), F.lower(bare))


def display_guid(guid: Column) -> Column:
    return F.coalesce(F.lower(F.hex(guid)), F.lit("default"))


def shortened(text: Column, n: int = 64) -> Column:
    """The first n characters and an ellipsis, or all of a text that is no longer."""
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def short_digest(digest: Column) -> Column:
    return F.concat(F.left(F.lower(F.hex(digest)), F.lit(16)), F.lit("..."))


def codec_prefix(key: Column) -> Column:
    return F.substring_index(key, "_", 1)


def supports_codec(codec: Column, codecs: list[str]) -> Column:
    return F.coalesce(F.lower(codec).isin([c.lower() for c in codecs]), F.lit(False))


def ascii_text(data: Column) -> Column:
    """Bytes as ASCII, a point for what cannot be printed."""
    return F.regexp_replace(F.decode(data, "ISO-8859-1"), "[^ -~]", ".")


def colour_hex(r: Column, g: Column, b: Column, a: Column) -> Column:
    """#RRGGBB, and AA unless it is FF."""
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b), F.when(a == 255, "").otherwise(two(a)))


def log_passes(level: Column, target: Column, message: Column, most: str = "TRACE", target_part: str = "", message_part: str = "") -> Column:
    """Grave enough, and both texts hold what is looked for."""
    return level.isin(*LEVELS[: LEVELS.index(most) + 1]) & F.contains(target, F.lit(target_part)) & F.contains(message, F.lit(message_part))


def log_line(level: Column, target: Column, message: Column) -> Column:
    return F.concat_ws(" ", F.rpad(level, 5, " "), target, message)


def cell_text(kind: Column, value: Column) -> Column:
    """A table's cell for a property's JSON: scalars plainly, of an enum its value, everything else as JSON."""
    return F.when(kind.isin(*PLAIN), F.get_json_object(value, "$")).when(kind == "Enum", F.get_json_object(value, "$.value")).otherwise(value)


def scalar_text(kind: Column, value: Column) -> Column:
    """One line for a property's JSON: strings quoted, enums with their type, objects by name, lists by length."""
    get = lambda k: F.coalesce(F.get_json_object(value, f"$.{k}"), F.lit(""))
    or_else = lambda test, a, b: F.when(test, a).otherwise(b)
    plain = F.get_json_object(value, "$")
    return (
        F.when(kind == "Str", F.concat(F.lit('"'), plain, F.lit('"')))
        .when(kind.isin(*PLAIN), plain)
        .when(kind == "Enum", or_else(get("type") == "", get("value"), F.concat(get("type"), F.lit("::"), get("value"))))
        .when(kind.isin("SoftObjectPath", "SoftClassPath"), or_else(get("sub_path") == "", get("asset_path"), F.concat(get("asset_path"), F.lit(":"), get("sub_path"))))
        .when(kind == "Object", or_else(get("name") == "", F.lit("<null>"), get("name")))
        .when(kind.isin("Array", "Set", "Map", "Struct"), F.concat(F.lit("["), F.coalesce(F.json_array_length(value), F.lit(0)).cast("string"), F.lit("]")))
        .when(kind == "Unknown", F.concat(F.lit("<"), get("type"), F.lit(": "), get("skipped_bytes"), F.lit(" bytes>")))
        .otherwise("<unhandled>")
    )
