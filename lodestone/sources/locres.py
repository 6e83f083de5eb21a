"""Localisation resources: files to rows, and rows to CSV and JSON.

Files are read by Spark's binaryFile source, so any path Spark reads will do; each file is parsed
by itself in a task and gives one row per entry, or one with `error`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pak import BadArchive, Cursor

SCHEMA = "source string, version int, namespace string, namespace_hash long, key string, key_hash long, source_string_hash long, localized string, pos int, error string"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Fixed value: the mark of versions 1 to 3, four words.
MAGIC = b"".join(x.to_bytes(4, "little") for x in (0x7574140E, 0xFC034A67, 0x9D90154A, 0x1B7F37C3))
MOST = 1 << 20


def parse(data: bytes) -> Iterator[tuple]:
    """(version, namespace, hash, key, hash, source hash, localized) of each entry."""
    c, version = Cursor(data), 0

    def text() -> str:
        at = c.at
        if c.read("i") == 0:
            return ""
        c.at = at
        got = c.text()
        if "\0" in got:
            raise BadArchive("NUL inside a string")
        return got

    def count() -> int:
        if (n := c.read("I")) > MOST:
            raise BadArchive(f"{n} entries")
        return n

    strings, strings_at = [], None
    if data.startswith(MAGIC) and len(data) > 16:
        c.at, version = 17, data[16]
        if not 1 <= version <= 3:
            raise BadArchive(f"version {version}")
        if (strings_at := c.read("q")) != -1:
            if not 25 <= strings_at < len(data):
                raise BadArchive("strings outside the file")
            back, c.at = c.at, strings_at
            for _ in range(count()):
                strings.append(text())
                if version >= 2:
                    c.read("i")
            c.at = back
        if version >= 2:
            c.read("I")
    hashed = (lambda: c.read("I")) if version >= 2 else (lambda: 0)
    found = []
    for _ in range(count()):
        ns_hash, ns = hashed(), text()
        for _ in range(count()):
            key_hash, key, source_hash = hashed(), text(), c.read("I")
            if version:
                i = c.read("i")
                if not 0 <= i < len(strings):
                    raise BadArchive(f"string {i} of {len(strings)}")
                found.append((version, ns, ns_hash, key, key_hash, source_hash, strings[i]))
            else:
                found.append((version, ns, ns_hash, key, key_hash, source_hash, text()))
    if strings and strings_at < c.at:
        raise BadArchive("strings inside the entries")
    yield from found


def read_locres(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all files at path."""

    def run(batches):
        for batch in batches:
            out = []
            for source, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += [(source, *row, i, None) for i, row in enumerate(parse(data))]
                except (BadArchive, UnicodeDecodeError) as x:
                    out.append((source, *[None] * 8, str(x)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()))], _NAMES)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def as_csv_rows(rows: DataFrame) -> DataFrame:
    """The three columns of the CSV form."""
    return rows.filter("error IS NULL").select("namespace", "key", "localized")


def as_json(rows: DataFrame) -> DataFrame:
    """(source, document): a file's namespaces in file order, with all hashes."""
    entry = F.struct("key", "key_hash", "source_string_hash", "localized")
    spaces = rows.filter("error IS NULL").groupBy("source", "version", "namespace", "namespace_hash").agg(F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("e"))
    space = F.struct("first", F.struct("namespace", "namespace_hash", F.transform("e", lambda x: x["e"]).alias("entries")).alias("n"))
    files = spaces.groupBy("source", "version").agg(F.transform(F.array_sort(F.collect_list(space)), lambda x: x["n"]).alias("namespaces"))
    return files.select("source", F.to_json(F.struct("version", "namespaces")).alias("document"))
