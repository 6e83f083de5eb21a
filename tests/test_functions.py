"""Column functions and operators on small cases with known answers."""

import math

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import numeric, paths
from lodestone.operators import entries, lookups, shapes


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "ext"), [("a/b.UAsset", "uasset"), (".uasset", None), ("Game/.uasset", None), ("a.", ""), ("a.b/c", None), ("x.tar.gz", "gz"), ("", None)])
def test_extension(spark, path, ext):
    assert one(spark, paths.extension(F.lit(path))) == ext


@pytest.mark.parametrize(
    ("glob", "path", "hit"),
    [("Game/*", "Game/a/b", True), ("*.u?sset", "x/y.uasset", True), ("[!a]*", "abc", False), ("[a-c]*", "b", True), ("**/x", "a/b/x", True), ("a.b", "axb", False), ("", "", True), ("[", "[", True)],
)
def test_glob(spark, glob, path, hit):
    assert one(spark, F.lit(path).rlike(paths.glob_regex(glob))) is hit


@pytest.mark.parametrize(("text", "n"), [("10 MiB", 10 << 20), ("5kb", 5000), ("7", 7), (" 1 B ", 1), ("0gib", 0)])
def test_parse_size(text, n):
    assert paths.parse_size(text) == n


@pytest.mark.parametrize("text", ["", "MiB", "1.5 MiB", "-1", "1 qb", "99999999999999999999", "99999999 TiB"])
def test_parse_size_refuses(text):
    with pytest.raises(ValueError):
        paths.parse_size(text)


@pytest.mark.parametrize(("n", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KiB"), (8 << 30, "8.0 GiB"), (3 << 40, "3.0 TiB")])
def test_format_size(spark, n, text):
    assert one(spark, paths.format_size(F.lit(n).cast("long"))) == text


@pytest.mark.parametrize(("raw", "safe"), [("a/b", "a/b"), ("a\\..\\b", None), ("/a", None), ("c:/a", None), ("", None), ("./", None), (".//a/./b", "a/b")])
def test_safe_path(spark, raw, safe):
    assert one(spark, paths.safe_path(F.lit(raw))) == safe


def test_small_labels(spark):
    assert one(spark, paths.minutes(F.lit(75.9))) == "1:15"
    assert one(spark, paths.minutes(F.lit(-3.0))) == "0:00"
    assert one(spark, paths.column_header(F.lit("a"), F.lit(2))) == "a[2]"
    assert one(spark, paths.display_text(F.lit("a\x07b\x85"))) == "a�b�"
    assert one(spark, paths.companion_path(F.lit("A.UASSET"), ".uexp")) == "A.uexp"


def fnv(path, seed=0):
    h = (numeric.FNV_BASIS + seed) % 2**64
    for b in "".join(c.lower() if c.isascii() else c for c in path).encode("utf-16-le"):
        h = (h ^ b) * numeric.FNV_PRIME % 2**64
    return f"{h:016x}"


@settings(max_examples=10, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=20), st.integers(0, 2**64 - 1))
def test_path_hash(spark, path, seed):
    assert one(spark, numeric.path_hash(F.lit(path), seed)) == fnv(path, seed)


def test_renormalized(spark):
    w = lambda *x: F.array(*[F.lit(i).cast("long") for i in x])
    assert one(spark, numeric.renormalized(w(0, 0, 0))) == [255, 0, 0]
    assert one(spark, numeric.renormalized(w(1, 1, 1))) == [85, 85, 85]
    got = one(spark, numeric.renormalized(w(7, 7, 3, 1)))
    assert sum(got) == 255
    assert got[1] >= got[0]


def test_tone_map_edges(spark):
    assert one(spark, numeric.byte(numeric.srgb(numeric.tone_map(F.lit(float("nan")))))) == 0
    assert one(spark, numeric.byte(numeric.srgb(numeric.tone_map(F.lit(-1.0))))) == 0
    assert one(spark, numeric.byte(numeric.srgb(numeric.tone_map(F.lit(float("inf")))))) == 255
    assert abs(one(spark, numeric.tone_map(F.lit(1.0))) - 2.54 / 3.16) < 1e-12


def test_unit_vector_of_zero(spark):
    assert one(spark, numeric.unit_vector(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    assert one(spark, numeric.unit_vector(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]


def test_search_without_predicates_keeps_all(spark):
    df = spark.createDataFrame([("a", 1)], "path string, size long")
    assert entries.search(df).count() == 1
    with pytest.raises(ValueError):
        entries.search(df, min_size="2", max_size="1")


def test_layers_and_cross_check(spark):
    local = spark.createDataFrame([("a", "L", 0)], "key string, name string, ord long")
    registry = spark.createDataFrame([("a", "R", 1), ("b", "R1", 3), ("b", "R0", 2)], "key string, name string, ord long")
    got = {(r["key"], r["name"], r["layer"]) for r in lookups.layered(local, registry, "key", "ord").collect()}
    assert got == {("a", "L", "local"), ("b", "R0", "registry")}
    x = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "k long, v string")
    y = spark.createDataFrame([(2, "r"), (3, None), (4, "s")], "k long, v string")
    assert {tuple(r) for r in lookups.cross_check(x, y, "k", "v").collect()} == {(1, "missing_right"), (2, "mismatch"), (4, "missing_left")}


def test_closure_ends_in_a_cycle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "node string, parent string")
    assert {tuple(r) for r in lookups.closure(df).drop("truncated").collect()} == {("a", "a", 0), ("a", "b", 1), ("b", "b", 0), ("b", "a", 1), ("c", "c", 0)}


def test_as_of_takes_the_last_of_equal_times(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9)], "id long, k string, t long")
    right = spark.createDataFrame([("k", 5, 1, "x"), ("k", 5, 2, None), ("k", 3, 9, "w")], "k string, at long, n long, v string")
    got = {r["id"]: r["v"] for r in lookups.as_of(left, right, "k", "t", ["at", "n"], "v").collect()}
    assert got == {1: None, 2: None, 3: None}
    got = {r["id"]: r["n2"] for r in lookups.as_of(left, right.withColumn("n2", F.col("n")), "k", "t", ["at", "n"], "n2").collect()}
    assert got == {1: 2, 2: None, 3: None}


def test_range_owner_last_ordinal_wins(spark):
    values = spark.createDataFrame([(1,), (10,), (99,), (-5,), (None,)], "v long")
    ranges = spark.createDataFrame([(0, 50, 1), (10, 11, 2), (5, 5, 3), (-10, 0, 4)], "lo long, hi long, ordinal long")
    assert {r["v"]: r["owner"] for r in lookups.range_owner(values, "v", ranges, 7).collect()} == {1: 1, 10: 2, 99: None, -5: 4, None: None}


def test_rounded_as_in_c(spark):
    x = [0.0, -0.0, 4e-7, -4e-7, 5e-7, -5e-7, 1.0000005, -2.5e-6, 1.005, 123456.7890125, 1e308, math.inf, -math.inf, math.nan, None]
    got = [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(numeric.rounded(F.col("x"), 6).alias("y")).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in x]
    assert list(map(repr, got)) == list(map(repr, want))
    assert repr(got[3]) == "-0.0"


def test_rules_without_tests_hold_nothing(spark):
    assert one(spark, shapes.rules_hold([])) is False
    assert one(spark, shapes.rules_hold([F.lit(True)])) is True
    assert one(spark, shapes.rules_hold([F.lit(True), F.lit(None).cast("boolean")])) is False
