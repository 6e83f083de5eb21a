"""Paths, globs, sizes and labels as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of sizes in filters (decimal and binary).
UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}
#: Extensions by class of entry.
CLASSES = {"asset": ("uasset", "umap"), "companion": ("uexp", "ubulk", "uptnl"), "locres": ("locres",)}


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension of the last component; null for none (".x" has none, "x." an empty one)."""
    base = basename(path)
    return F.when(base.rlike(r"(?s)^.+\."), F.lower(F.regexp_extract(base, r"(?s)^.+\.([^.]*)$", 1)))


def glob_regex(glob: str) -> str:
    """An anchored regex for a glob whose *, ? and sets also match "/"; ** is a whole component, any number of folders, and an error elsewhere."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            whole = (i == 0 or glob[i - 1] == "/") and glob[i + 2 : i + 3] in ("", "/")
            if not whole:
                raise ValueError(f"** is no component of its own: {glob!r}")
            out.append(".*" if i + 2 == len(glob) else "(?:.*/)?")
            i += 3
            continue
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (j := glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!"))) > 0:
            body = glob[i + 1 : j]
            out.append("[" + ("^" if body[0] == "!" else "") + re.sub(r"([\\\[\]^])", r"\\\1", body.lstrip("!") if body[0] == "!" else body) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def parse_size(text: str) -> int:
    """Bytes of "10 MiB", "5kb" or "7"; ValueError for anything else or more than 64 bits."""
    m = re.fullmatch(r"(\d+)\s*([a-zA-Z]*)", text.strip(), re.ASCII)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    n = int(m[1]) * UNITS[m[2].lower()]
    if n >= 1 << 64:
        raise ValueError(f"size is too large: {text!r}")
    return n


def format_size(n: Column) -> Column:
    """Bytes plainly below 1 KiB, else one decimal of the largest binary unit up to TiB, halves to the even digit; null for null."""
    # format_string alone rounds halves up, and prints a null
    text = lambda k, unit: F.format_string(f"%.1f {unit}", F.bround(n / float(1024**k), 1))
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(n < 1024 ** (k + 1), text(k, unit))
    return out.when(n.isNotNull(), text(4, "TiB"))


def exact_size_label(n: Column) -> Column:
    """The largest of GiB, MiB, KiB that divides n, else bytes."""
    out = None
    for k, unit in ((3, "GiB"), (2, "MiB"), (1, "KiB")):
        hit, text = (n >= 1024**k) & (n % 1024**k == 0), F.concat((n / 1024**k).cast("long").cast("string"), F.lit(f" {unit}"))
        out = F.when(hit, text) if out is None else out.when(hit, text)
    return out.otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def entry_class(path: Column) -> Column:
    ext = extension(path)
    out = F.when(ext.isin(*CLASSES["asset"]), "asset")
    for name in ("companion", "locres"):
        out = out.when(ext.isin(*CLASSES[name]), name)
    return out.otherwise("raw")


def safe_path(path: Column, flat: bool = False) -> Column:
    """Relative path below a root, without empty and "." parts; null if it would escape or is empty."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    bad = (path == "") | p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    kept = F.element_at(parts, -1) if flat else F.array_join(parts, "/")
    return F.when(~bad, kept)


def companion_path(path: Column, ext: str) -> Column:
    """path with its .uasset suffix (any case) replaced, or ext appended."""
    return F.when(F.lower(path).endswith(".uasset"), F.concat(F.regexp_replace(path, r"(?i)\.uasset$", ""), F.lit(ext))).otherwise(F.concat(path, F.lit(ext)))


def column_header(name: Column, index: Column) -> Column:
    return F.when(index == 0, name).otherwise(F.concat(name, F.lit("["), index.cast("string"), F.lit("]")))


def display_text(text: Column) -> Column:
    """Control characters as U+FFFD."""
    return F.regexp_replace(text, r"\p{Cc}", "�")


def minutes(seconds: Column) -> Column:
    """m:ss, not below 0:00."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    return F.concat((s / 60).cast("long").cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
