"""Archives made here, read back through Spark."""

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.operators import entries
from lodestone.sources import pak


def text(s):
    return struct.pack("<i", len(s) + 1) + s.encode() + b"\0" if s.isascii() else struct.pack("<i", -len(s) - 1) + s.encode("utf-16-le") + b"\0\0"


def record(offset, size, whole, method, sha1, blocks, block_size):
    out = struct.pack("<QQQI", offset, size, whole, method) + sha1
    if method:
        out += struct.pack("<I", len(blocks)) + b"".join(struct.pack("<QQ", *b) for b in blocks)
    return out + struct.pack("<BI", 0, block_size)


def archive(files, version, block=256, squeeze=zlib.compress, slot="Zlib"):
    """files: (path, bytes, compressed). Version 5, 7, 9 or 11."""
    body, index = b"", []
    for path, data, packed in files:
        parts = [squeeze(data[i : i + block]) for i in range(0, max(len(data), 1), block)] if packed else []
        stored = b"".join(parts) if packed else data
        head, blocks = 53 + (4 + 16 * len(parts) if packed else 0), []
        at = head
        for p in parts:
            blocks.append((at, at + len(p)))
            at += len(p)
        sha1 = hashlib.sha1(stored).digest()
        args = (len(stored), len(data), int(packed), sha1, blocks, block if packed else 0)
        index.append((path, len(body), *args))
        body += record(0, *args) + stored
    mount = text("../../../")
    if version < 10:
        listing = mount + struct.pack("<I", len(files)) + b"".join(text(p) + record(*rest) for p, *rest in index)
        tail = b""
    else:
        blob, folders = b"", {}
        for path, offset, size, whole, method, _, blocks, bs in index:
            folder, _, name = path.rpartition("/")
            folders.setdefault("/" + folder + "/" if folder else "/", []).append((name, len(blob)))
            blob += struct.pack("<I", 1 << 31 | 1 << 30 | 1 << 29 | method << 23 | len(blocks) << 6 | (0x3F if method else 0))
            blob += (struct.pack("<I", bs) if method else b"") + struct.pack("<II", offset, whole) + (struct.pack("<I", size) if method else b"")
            if len(blocks) > 1:
                blob += b"".join(struct.pack("<I", b - a) for a, b in blocks)
        tail = struct.pack("<I", len(folders)) + b"".join(text(d) + struct.pack("<I", len(x)) + b"".join(text(n) + struct.pack("<i", o) for n, o in x) for d, x in folders.items())
        rest = struct.pack("<I", len(blob)) + blob + struct.pack("<I", 0)
        start = mount + struct.pack("<IQII", len(files), 0, 0, 1)
        listing = start + struct.pack("<QQ", len(body) + len(start) + 36 + len(rest), len(tail)) + bytes(20) + rest
    footer = struct.pack("<IIQQ", pak.MAGIC, version, len(body), len(listing)) + hashlib.sha1(listing).digest()
    if version >= 7:
        footer = bytes(17) + footer
    if version == 9:
        footer += b"\0"
    if version >= 8:
        footer += slot.encode().ljust(32, b"\0") + bytes(128)
    return body + listing + tail + footer


def lz4_literals(data):
    """An LZ4 block of literals only."""
    n = len(data)
    return bytes([min(n, 15) << 4]) + (b"\xff" * ((n - 15) // 255) + bytes([(n - 15) % 255]) if n >= 15 else b"") + data


@pytest.fixture(scope="module")
def files():
    rng = random.Random(1)
    return [("root.txt", b"hello", False), ("Content/a.uasset", bytes(rng.randrange(256) for _ in range(900)), True), ("Content/Sub/Deep/nested.uasset", b"ab" * 700, True), ("Content/empty.uexp", b"", False), ("Content/naïve.locres", b"x", False)]


@pytest.fixture(scope="module")
def source(spark):
    pak.register(spark)
    return spark.read.format("pak")


@pytest.mark.parametrize("version", [5, 7, 9, 11])
def test_versions(spark, source, files, tmp_path, version):
    (tmp_path / "a.pak").write_bytes(archive(files, version))
    rows = source.option("content", "true").option("entriesPerPartition", "2").load(str(tmp_path / "a.pak")).collect()
    assert {r["path"]: bytes(r["content"]) for r in rows} == {p: d for p, d, _ in files}
    assert sorted(r["pos"] for r in rows) == list(range(len(files)))
    assert all(r["error"] is None and r["size"] == len(r["content"]) for r in rows)
    plain = source.option("content", "false").load(str(tmp_path / "a.pak"))
    assert plain.filter("content IS NOT NULL").count() == 0
    found = entries.search(plain, glob="Content/**", ext=["uasset"], min_size="1 KB")
    assert [r["path"] for r in found.collect()] == ["Content/Sub/Deep/nested.uasset"]


def test_lz4_and_last_duplicate(source, tmp_path):
    data = archive([("x", b"old", False), ("y", b"q" * 600, True), ("x", b"new", False)], 9, squeeze=lz4_literals, slot="LZ4")
    (tmp_path / "a.pak").write_bytes(data)
    rows = source.option("content", "true").load(str(tmp_path / "a.pak")).collect()
    assert {r["path"]: bytes(r["content"]) for r in rows} == {"y": b"q" * 600, "x": b"new"}


def test_lz4_matches():
    assert pak.lz4_block(b"\x12a\x01\x00", 7) == b"a" * 7
    assert pak.lz4_block(b"\x32abc\x03\x00\x10z", 10) == b"abcabcabcz"
    with pytest.raises(pak.BadArchive):
        pak.lz4_block(b"\x12a\x05\x00", 7)


def test_bad_archives_and_payloads(source, files, tmp_path):
    good = archive(files, 9)
    (tmp_path / "a.pak").write_bytes(good)
    (tmp_path / "b.pak").write_bytes(b"no archive")
    (tmp_path / "c.pak").write_bytes(good[:60] + bytes(200) + good[260:])
    with pytest.raises(Exception, match="no footer"):
        source.option("content", "false").option("badArchives", "fail").load(f"{tmp_path}/*.pak").collect()
    rows = source.option("content", "true").option("badArchives", "rows").load(f"{tmp_path}/*.pak")
    by = {r["source"][-5:]: r["n"] for r in rows.groupBy("source").agg(F.count("error").alias("n")).collect()}
    assert by["a.pak"] == 0
    assert by["b.pak"] == 1
    assert by["c.pak"] >= 1
    with pytest.raises(Exception, match="no archive matches"):
        source.load(f"{tmp_path}/*.nope").collect()


def test_verify_of_stored_payloads(spark, source, tmp_path):
    (tmp_path / "a.pak").write_bytes(archive([("x", b"abc", False)], 7))
    rows = source.option("content", "true").load(str(tmp_path / "a.pak"))
    assert rows.select(entries.verify_outcome(F.col("content"), F.col("sha1"), F.lit(True)).alias("o")).first()["o"] == "verified"
