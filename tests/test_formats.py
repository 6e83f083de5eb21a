"""Localisation files, sinks, textures, audio and streams."""

import io
import json
import struct
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import audio, textures
from lodestone.sources import locres, sinks
from lodestone.streaming import events
from tests.test_pak import text


def resource(version, spaces):
    """spaces: (namespace, [(key, localized)])."""
    strings = sorted({v for _, e in spaces for _, v in e})
    h = struct.pack("<I", 7) if version >= 2 else b""
    body = struct.pack("<I", len(spaces))
    for ns, entries in spaces:
        body += h + text(ns) + struct.pack("<I", len(entries))
        for k, v in entries:
            body += h + text(k) + struct.pack("<I", 9) + (struct.pack("<i", strings.index(v)) if version else text(v))
    if not version:
        return body
    body = (struct.pack("<I", 0) if version >= 2 else b"") + body
    tail = struct.pack("<I", len(strings)) + b"".join(text(s) + (struct.pack("<i", 1) if version >= 2 else b"") for s in strings)
    return locres.MAGIC + bytes([version]) + struct.pack("<q", 25 + len(body)) + body + tail


SPACES = [("Game", [("k1", "Hello"), ("k2", "naïve")]), ("Menu", [("k1", 'a "b", c\nd')])]


@pytest.mark.parametrize("version", [0, 1, 2, 3])
def test_locres(spark, tmp_path, version):
    (tmp_path / "a.locres").write_bytes(resource(version, SPACES))
    (tmp_path / "b.locres").write_bytes(resource(version, SPACES)[:-3])
    rows = locres.read_locres(spark, str(tmp_path))
    assert [(r["namespace"], [(r["key"], r["localized"])]) for r in rows.filter("error IS NULL").orderBy("pos").collect()] == [(n, [e]) for n, x in SPACES for e in x]
    assert rows.filter("error IS NOT NULL").count() == 1
    sinks.write_csv(locres.as_csv_rows(rows), str(tmp_path / "csv"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"').collect()} == {(n, k, v) for n, x in SPACES for k, v in x}
    doc = json.loads(locres.as_json(rows).first()["document"])
    assert [n["namespace"] for n in doc["namespaces"]] == ["Game", "Menu"]
    assert doc["namespaces"][0]["entries"][1]["localized"] == "naïve"


def test_data_table(spark, tmp_path):
    cells = spark.createDataFrame([("Sword", 0, "Cost", 0, "100"), ("Sword", 1, "Damage", 0, "10"), ("Sword", 2, "Damage", 1, "11"), ("Bow", 0, "Damage", 0, "8"), ("Bow", 1, "Range", 0, ""), ("Bow", 2, "Damage", 0, "late")], "row string, pos int, name string, i int, value string")
    order = [F.when(F.col("row") == "Sword", 0).otherwise(1).alias("r"), "pos"]
    cells = cells.withColumn("r", order[0])
    wide = sinks.data_table(cells, "row", "name", "i", "value", ["r", "pos"])
    assert wide.columns == ["Name", "Cost", "Damage", "Damage[1]", "Range"]
    assert {tuple(x) for x in wide.collect()} == {("Sword", "100", "10", "11", None), ("Bow", None, "8", None, "")}
    doc = sinks.data_table_json(cells.withColumn("t", F.lit("T")), "t", "row", "name", "value", ["r", "pos"]).first()["document"]
    assert [r["name"] for r in json.loads(doc)["rows"]] == ["Sword", "Bow"]
    sinks.write_listing(cells.select("row"), str(tmp_path / "l"))
    with pytest.raises(Exception, match="exists"):
        sinks.write_listing(cells.select("row"), str(tmp_path / "l"))
    out = spark.createDataFrame([("a", "converted", None), ("c", "failed", "x"), ("b", "failed", "y")], "entry string, kind string, reason string")
    got = sinks.summary(out).first()
    assert got["counts"]["failed"] == 2
    assert [f["entry"] for f in got["failures"]] == ["b", "c"]


def test_textures():
    red = struct.pack("<HHI", 0xF800, 0x001F, 0)
    assert textures.decode("BC1", red, 3, 2) == bytes([255, 0, 0, 255]) * 6
    clear = struct.pack("<HHI", 0x001F, 0xF800, 0xFFFFFFFF)
    assert textures.decode("BC1", clear, 1, 1) == bytes(4)
    assert textures.decode("BC3", bytes([200, 100]) + bytes(6) + red, 1, 1) == bytes([255, 0, 0, 200])
    assert textures.decode("BC2", b"\x0f" * 8 + red, 2, 1) == bytes([255, 0, 0, 255, 255, 0, 0, 0])
    assert textures.decode("BC4", bytes([90, 10]) + bytes(6), 1, 1) == bytes([90, 90, 90, 255])
    ramp = np.frombuffer(textures.decode("BC4", bytes([0, 255]) + (0o76543210).to_bytes(3, "little") + bytes(3), 4, 2), np.uint8)[::4]
    assert ramp.tolist() == [0, 255, 51, 102, 153, 204, 0, 255]
    assert textures.decode("BC5", bytes([128, 0]) + bytes(6) + bytes([128, 0]) + bytes(6), 1, 1) == bytes([128, 128, 254, 255])
    assert textures.decode("B8G8R8A8", b"\1\2\3\4", 1, 1) == b"\3\2\1\4"
    assert textures.decode("G16", b"\1\x80", 1, 1) == b"\x80\x80\x80\xff"
    assert textures.decode("FloatRGBA", np.array([1, 0, np.nan, 0.5], "<f2").tobytes(), 1, 1) == bytes([232, 0, 0, 128])
    assert textures.decode("FloatRGB", struct.pack("<I", 15 << 6 | (15 << 6) << 11 | (15 << 5) << 22), 1, 1) == bytes([232, 232, 232, 255])
    with pytest.raises(ValueError, match="bytes of"):
        textures.decode("BC1", b"", 4, 4)


def test_png(spark):
    df = spark.createDataFrame([("G8", bytearray(b"\0\x80"), 2, 1), ("ASTC", bytearray(b""), 1, 1), ("G8", bytearray(b""), 1, 1)], "f string, d binary, w int, h int")
    rows = df.select(textures.to_png(F.col("f"), F.col("d"), F.col("w"), F.col("h")).alias("p")).collect()
    png = bytes(rows[0]["p"]["png"])
    idat = png[png.index(b"IDAT") + 4 : png.index(b"IEND") - 8]
    assert zlib.decompress(idat) == b"\0" + b"\0\0\0\xff" + b"\x80\x80\x80\xff"
    assert "not supported" in rows[1]["p"]["error"]
    assert "bytes of" in rows[2]["p"]["error"]


def test_wav(spark):
    data = struct.pack("<6h", 1, -1, 300, -300, 32767, -32768)
    df = spark.createDataFrame([(bytearray(data), 2, 44100)], "d binary, c int, r int")
    got = df.select(audio.pcm_wav(F.col("d"), F.col("c"), F.col("r")).alias("w")).select("w", audio.wav_info(F.col("w")).alias("i")).first()
    with wave.open(io.BytesIO(bytes(got["w"]))) as w:
        assert (w.getnchannels(), w.getframerate(), w.getsampwidth(), w.getnframes()) == (2, 44100, 2, 3)
        assert w.readframes(9) == data
    assert tuple(got["i"]) == (2, 44100, 16, 3)


def test_streams(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), batch.schema)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = run(events.last_by_key(stream.select("user_id", "event_id", "value"), ["user_id"], "event_id"), "last_rows", "complete")
    want = batch.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert got.select("user_id", "event_id").exceptAll(want).count() == 0
    assert got.count() == want.count()
    counts = run(events.windowed_counts(stream, late="1000 days"), "window_counts", "complete")
    assert counts.agg(F.sum("n")).first()[0] == batch.count()
