"""Functions and operators over assets on known cases."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import audio, bulk, geometry, paths, textures, texts
from lodestone.operators import dispatch, documents, entries, integrity, lookups, schemas
from lodestone.sources import pak


def values(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_versions(spark):
    text = ["UE4.27", "ue 5.3.2", " 5.1 ", "4", "4.x", "1.2.3.4", "4294967296.1", "UE", "5.+2", ""]
    got = values(spark, *[texts.version(F.lit(t)) for t in text])
    assert [tuple(v) if v else None for v in got] == [(4, 27, None), (5, 3, 2), (5, 1, None), None, None, None, None, None, (5, 2, None), None]
    assert values(spark, texts.engine_gate(F.lit("ambiguous"), texts.version(F.lit("4.27")), 4, 27), texts.engine_gate(F.lit("ambiguous"), texts.version(F.lit("x")), 4, 0)) == (True, False)


def test_texts(spark):
    assert values(spark, texts.hex_bytes(F.lit("0aFF")), texts.hex_bytes(F.lit("")), texts.hex_bytes(F.lit("abc"))) == (b"\x0a\xff", None, None)
    assert values(spark, texts.guid_hex(F.lit("0X" + "AB" * 16)), texts.guid_hex(F.lit("AB" * 15)), texts.display_guid(F.lit(None).cast("binary"))) == ("ab" * 16, None, "default")
    assert values(spark, texts.shortened(F.lit("x" * 64)), texts.shortened(F.lit("x" * 65))) == ("x" * 64, "x" * 64 + "…")
    assert values(spark, texts.ascii_text(F.lit(bytearray(b"a\x00\xe9~\n"))), texts.log_line(F.lit("WARN"), F.lit("t"), F.lit("m"))) == ("a..~.", "WARN  t m")
    assert values(spark, texts.scalar_text(F.lit("Str"), F.lit('"a"')), texts.scalar_text(F.lit("Enum"), F.lit('{"type":"","value":"A"}')), texts.scalar_text(F.lit("SoftObjectPath"), F.lit('{"asset_path":"/a","sub_path":"b"}'))) == ('"a"', "A", "/a:b")


def test_navigation(spark):
    doc = F.parse_json(F.lit('{"a":{"0":1,"b.c":2,"it\'s":3},"l":[{"x":null},[7,8]]}'))
    at = lambda p: F.to_json(documents.navigate(doc, p))
    assert values(spark, at("a.0"), at("l.1..1."), at("l.2"), at("a.it's"), at("l.0.x.y"), at("l.first")) == ("1", "8", None, "3", None, None)
    names = F.array(*map(F.lit, ("a", "b", "a")))
    got = values(spark, *[documents.select_export(names, F.lit(s)) for s in ("1", "3", "b", "a", "c", "-1")])
    assert [tuple(x) for x in got] == [(1, None), (None, "out of range"), (1, None), (None, "ambiguous"), (None, "unknown"), (None, "unknown")]


def test_flatten_is_capped(spark):
    docs = spark.createDataFrame([(1, '{"a":[1,2,3,4],"b":{"c":null}}'), (2, "5"), (3, None)], "id int, t string").select("id", F.parse_json("t").alias("d"))
    rows = documents.flatten(docs, "id", "d", cap=3).collect()
    assert sum(r["id"] == 1 for r in rows) == 4
    whole = {(r["id"], ".".join(s["label"] for s in r["path"])): r["value"] for r in documents.flatten(docs, "id", "d").collect()}
    assert whole[1, ""] == "[2]"
    assert whole[1, "a"] == "[4]"
    assert whole[1, "a.3"] == "4"
    assert whole[1, "b.c"] == "null"
    assert whole[2, ""] == "5"
    closed = documents.flatten(docs, "id", "d", F.col("label") != "a").filter("id = 1")
    assert closed.count() == 4


def test_chains_end_at_64_classes(spark):
    chain = lambda n, tag: [(f"{tag}{i}", f"{tag}{i + 1}" if i + 1 < n else None) for i in range(n)]
    parents = spark.createDataFrame([*chain(65, "a"), *chain(64, "b"), ("x", "y"), ("y", "x"), ("z", "missing")], "node string, parent string")
    before = spark.catalog.listTables()
    rows = lookups.closure(parents).filter("root IN ('a0', 'a1', 'b0', 'x', 'z')").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.bool_or("truncated").alias("t")).collect()
    assert {r["root"]: (r["n"], r["t"]) for r in rows} == {"a0": (64, True), "a1": (64, False), "b0": (64, False), "x": (2, False), "z": (2, False)}
    assert len(spark.catalog.listTables()) == len(before)


def test_slots(spark):
    classes = spark.createDataFrame([("C", "B", 2), ("B", "A", 3), ("A", None, 1), ("Big", "", 65535), ("Over", "Big", 3)], "class string, super string, prop_count int")
    props = spark.createDataFrame([("C", 1, "c1"), ("B", 0, "b0"), ("A", 0, "a0"), ("Over", 2, "o2"), ("Big", 65534, "last")], "class string, schema_index int, name string")
    rows = {(r["class"], r["name"]): r["slot"] for r in schemas.flattened_slots(classes, props).collect()}
    assert rows["C", "c1"] == 1
    assert rows["C", "b0"] == 2
    assert rows["C", "a0"] == 5
    assert rows["Over", "last"] == 65535
    with pytest.raises(ValueError, match="slots"):
        schemas.flattened_slots(classes, props, most=5)


def test_bones(spark):
    half = math.sqrt(0.5)
    bones = [("s", 0, -1, [0.0, 0.0, half * 3, half * 3], [100.0, 0.0, 0.0], [1.0, 1.0, 1.0]), ("s", 1, 0, [0.0, 0.0, 0.0, 1.0], [0.0, 50.0, 0.0], [2.0, 2.0, 2.0]), ("s", 2, 9, [0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.0], [0.0, 1.0, 1.0])]
    rows = spark.createDataFrame(bones, "k string, bone int, parent int, rotation array<double>, translation array<double>, scale array<double>")
    got = {r["bone"]: r["matrix"] for r in geometry.inverse_binds(rows, "k").collect()}
    # a quarter turn about z takes the child's y to -x, so it stands at x = 100 - 50
    world = np.linalg.inv(np.array(got[1]).reshape(4, 4).T)
    assert np.allclose(world[:3, 3], [0.5, 0, 0])
    assert np.allclose(np.abs(np.linalg.det(world[:3, :3])), 8)
    assert got[2] is None


def test_adpcm_blocks(spark):
    rng = np.random.default_rng(4)
    stereo = struct.pack("<hBB", 5, 3, 0) + struct.pack("<hBB", -7, 88, 0) + bytes(rng.integers(0, 256, 16, np.uint8))
    rows = spark.createDataFrame([(stereo, 2), (stereo[:8] + stereo[8:12] + stereo[12:16], 2), (struct.pack("<hBB", 0, 89, 0) + bytes(4), 1), (b"\0", 1), (None, 1), (stereo, 3)], "b binary, c int")
    got = [r[0] for r in rows.select(audio.ima_samples("b", "c")).collect()]
    assert got[0][:2] == [5, -7]
    assert len(got[0]) == 2 * (1 + 16)
    assert got[2:] == [None] * 4
    left = struct.pack("<hBB", 5, 3, 0) + stereo[8:12] + stereo[16:20]
    alone = spark.createDataFrame([(left, 1)], "b binary, c int").select(audio.ima_samples("b", "c")).first()[0]
    assert got[0][::2] == alone
    ms = bytes([0, 2]) + struct.pack("<hhhhhh", 16, 200, 100, -50, 7, 9) + bytes([0x1F, 0x80])
    both = spark.createDataFrame([(ms, 2), (b"\x07" + ms[1:], 2)], "b binary, c int").select(audio.ms_samples("b", "c")).collect()
    assert both[0][0] == [7, 9, 100, -50, 116, -200, 116 - 8 * 16, 0]
    assert both[1][0] is None


def test_integrity(spark):
    v, n, s = (F.lit(x) for x in ("verified", "not_present", "skipped_no_hash"))
    assert values(spark, integrity.worst_of(v, n, s), integrity.worst_of(s, v), integrity.worst_of(v, F.lit(None).cast("string"))) == ("skipped_no_hash", "skipped_no_hash", "verified")
    assert values(spark, integrity.fully_verified(v, [n, v], F.lit(1), F.lit(0)), integrity.fully_verified(v, [n], F.lit(0), F.lit(0)), integrity.fully_verified(v, [s], F.lit(1), F.lit(0))) == (True, False, False)


def test_level_and_archive(spark):
    levels = spark.createDataFrame([("t", 0, 100), ("t", 1, 25), ("u", 0, 100)], "k string, l int, bytes int")
    assert {tuple(r) for r in dispatch.best_level(levels, "k", "l", F.col("bytes"), 30).collect()} == {("t", 1), ("u", None)}


def test_search_checks_patterns(spark):
    rows = spark.createDataFrame([("a/b", 1)], "path string, size long")
    with pytest.raises(ValueError, match="pattern"):
        entries.search(rows, regex="(?P<x>a)")
    assert entries.search(rows, regex="(?<x>a)").count() == 1
    for glob in ("a**", "**b", "a/***"):
        with pytest.raises(ValueError, match="component"):
            paths.glob_regex(glob)
    names = spark.createDataFrame([("a",), ("x/a",), ("x/y/a",), ("xa",)], "p string")
    assert {r[0] for r in names.filter(F.col("p").rlike(paths.glob_regex("**/a"))).collect()} == {"a", "x/a", "x/y/a"}


def test_owner_of_repeated_values(spark):
    ranges = spark.createDataFrame([(0, 50, 1), (10, 20, 2), (15, 30, 0), (40, 40, 9)], "lo long, hi long, ordinal long")
    rows = spark.createDataFrame([(5,), (5,), (10,), (19,), (20,), (29,), (49,), (50,), (None,)], "v long")
    got = [r["owner"] for r in lookups.range_owner(rows, "v", ranges, 16).orderBy(F.asc_nulls_last("v")).collect()]
    assert got == [1, 1, 2, 2, 1, 1, 1, None, None]


def test_archives_by_their_records(spark, tmp_path):
    pak.register(spark)
    files = [("a/x", b"x" * 70_000), ("a/y", b""), ("z", b"hello")]
    (tmp_path / "c.pak").write_bytes(pak.packed(files, block=1000))
    (tmp_path / "s.pak").write_bytes(pak.packed(files, compress=False))
    catalog = spark.read.format("pak").option("verifyIndex", "true").load(f"{tmp_path}/*.pak")
    rows = pak.contents(catalog).collect()
    assert {(r["source"][-5:], r["path"]): bytes(r["content"]) for r in rows} == {(s, p): d for s in ("c.pak", "s.pak") for p, d in files}
    one = catalog.filter("path = 'z' AND size > 3")
    assert one.count() == 2
    assert "pushFilters" not in one._jdf.queryExecution().executedPlan().toString()
    assert {(r["version"], r["key_guid"], r["error"]) for r in pak.footers(spark, f"{tmp_path}/*.pak").collect()} == {(9, None, None)}
    assert pak.entry_count(f"{tmp_path}/c.pak") == 3


def test_crafted_archives_fail_at_open(spark, tmp_path):
    pak.register(spark)
    good = pak.packed([("z", b"hello")], compress=False)
    huge = good.replace(struct.pack("<QQ", 5, 5), struct.pack("<QQ", 5, 1 << 63))
    long = good.replace(struct.pack("<QQ", 5, 5), struct.pack("<QQ", 5000, 5000))
    other = bytearray(good)
    other[len(good) - 222 - 20] ^= 1
    for name, data in (("huge", huge), ("long", long), ("other", bytes(other))):
        (tmp_path / f"{name}.pak").write_bytes(data)
    rows = spark.read.format("pak").option("badArchives", "rows").option("verifyIndex", "true").load(f"{tmp_path}/*.pak").collect()
    assert {r["source"].rsplit("/", 1)[1]: r["error"] is not None for r in rows} == {"huge.pak": True, "long.pak": True, "other.pak": True}
    rows = spark.read.format("pak").option("badArchives", "rows").load(f"{tmp_path}/huge.pak").collect()
    assert "past the end" in rows[0]["error"]


def test_chunked_payloads(spark):
    data, block = bytes(range(256)) * 3, 300
    parts = [zlib.compress(data[i : i + block]) for i in range(0, len(data), block)]
    head = struct.pack("<4q", bulk.CHUNK_MARK, block, sum(map(len, parts)), len(data)) + b"".join(struct.pack("<2q", len(p), min(block, len(data) - i * block)) for i, p in enumerate(parts))
    good = head + b"".join(parts)
    rows = spark.createDataFrame([(good, len(data)), (good, 5), (good[:-1], len(data)), (b"x" * 40, 1), (None, 1), (good[:40] + b"\xff" * 8 + good[48:], len(data))], "d binary, n long").select(bulk.inflated(F.col("d"), F.col("n")).alias("x")).select("x.*").collect()
    assert bytes(rows[0]["data"]) == data
    assert all(r["data"] is None and r["error"] for r in rows[1:])


def test_slabs_and_tiles():
    grey = bytes(range(8))
    assert textures.decode_slab("G8", grey, 2, 2, 2) == textures.decode("G8", grey[:4], 2, 2) + textures.decode("G8", grey[4:], 2, 2)
    with pytest.raises(ValueError, match="bytes"):
        textures.decode_slab("G8", grey, 2, 2, 3)
    tile = np.zeros((4, 4, 4), np.uint8)
    tile[1:3, 1:3] = 9
    got = np.frombuffer(textures.stitched([tile.tobytes(), (1, 2, 3, 4)], 2, 2, 1, 3, 2), np.uint8).reshape(2, 3, 4)
    assert (got[:, :2] == 9).all()
    assert (got[:, 2] == [1, 2, 3, 4]).all()
