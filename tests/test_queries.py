"""Every query of the library's own catalog against its SQL, and the entry points."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.operators import lookups, shapes
from lodestone.plans import catalog
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    same(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLE_SQL[name])


def test_entry_points(spark):
    assert entry.entry(spark).columns == ["path", "size"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_search_reaches_the_scan(spark, sf_dir):
    plan = catalog.QUERIES["entry_classify"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


def test_every_part_owns_ranges(spark):
    sf = "/root/testdata/sf0.01"
    ranges = [(r.p_partkey % 40 * 2000, r.p_partkey % 40 * 2000 + 500 + r.p_size * 100, r.p_partkey) for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size").collect()]
    best = {}
    for lo, hi, o in ranges:
        for v in range(lo, hi):
            best[v] = max(o, best.get(v, o))
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "floor(l_extendedprice) AS v").collect()
    want = sorted(((r.l_orderkey, r.l_linenumber, best.get(r.v)) for r in lines), key=repr)
    assert sorted((tuple(r) for r in catalog.QUERIES["range_owner_all"](spark, sf).collect()), key=repr) == want
    assert max(o or 0 for _, _, o in want) >= 200


@pytest.mark.parametrize("name", ["range_owner", "range_owner_all"])
def test_repeated_lines_have_one_owner(spark, tmp_path, name):
    lines = [(1, 1, 700.25), (1, 1, 700.75), (1, 1, 900.0), (1, 2, 700.25), (2, 1, 1999.0), (2, 1, 1999.0), (3, 1, None), (3, 1, None), (None, None, 700.0), (None, None, 700.5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(40, 1), (0, 3)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    assert got.count() == 6
    same(got, con, catalog.ORACLE_SQL[name])


def test_small_components_keep_their_sign(spark, tmp_path):
    v = [1.0, -1e-7, 4e-6, -4e-6, 5e-6, -5e-6, 0.0, -0.0, 1e-5, -0.123455]
    spark.createDataFrame([(1, v), (2, v[::-1])], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = {r.vec_id: repr(r.unit) for r in catalog.QUERIES["vector_normalize"](spark, str(tmp_path)).collect()}
    assert got == {k: repr(u) for k, u in con.execute(catalog.ORACLE_SQL["vector_normalize"]).fetchall()}
    assert "-0.0," in got[1]


def test_small_directions_keep_their_sign(spark, tmp_path):
    v = [[1.0, -1e-8, 4e-8, 1e-7], [-1e-8, 2.0, -5e-8, -1e-7], [3.0, 4.0, 0.0, 0.0], [3.0, -4.0, 1e-7, -0.0]]
    spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = sorted((r.vec_id, repr(r.position), repr(r.tangent)) for r in catalog.QUERIES["directions"](spark, str(tmp_path)).collect())
    assert got == sorted((i, repr(p), repr(t)) for i, p, t, _ in con.execute(catalog.ORACLE_SQL["directions"]).fetchall())
    assert got[0][1:] == ("[0.01, 0.0, -0.0]", "[1.0, 0.0, -0.0, -0.0]")


def test_sizes_halfway_and_null(spark, tmp_path):
    n = F.explode(F.array(*[F.lit(x) for x in (None, 0, 1023, 1024, *range(1280, 9000, 256), (5 << 18) - 1, 5 << 18, 7 << 18)]))
    spark.range(1).select(n.alias("n")).select(F.coalesce("n", F.lit(-1)).alias("page_id"), F.expr("repeat('x', n)").alias("html")).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = catalog.QUERIES["size_format"](spark, str(tmp_path))
    texts = {r.page_id: r.size_text for r in got.collect()}
    assert [texts[x] for x in (-1, 1280, 1792, 5 << 18, 7 << 18)] == [None, "1.2 KiB", "1.8 KiB", "1.2 MiB", "1.8 MiB"]
    same(got, con, catalog.ORACLE_SQL["size_format"])


def test_range_cells_keep_one_of_equal_pieces(spark):
    rows = [(0, 3000 + i % 3 * 10, i) for i in range(300)]
    cells = lookups.range_cells(spark.createDataFrame(rows, "lo long, hi long, ordinal long"), 1000)
    assert sorted(tuple(r) for r in cells.collect()) == [(0, 0, 1000, 299), (1, 1000, 2000, 299), (2, 2000, 3000, 299), (3, 3000, 3010, 298), (3, 3000, 3020, 299)]


def test_slices_hold_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert catalog.QUERIES["entry_list_multi_all"](spark, sf_dir).select("path").distinct().count() == docs
    faults = {r.doc_id: r.fault for r in catalog.QUERIES["hash_crosscheck_all"](spark, sf_dir).collect()}
    assert [faults.get(i) for i in (35, 70)] == ["missing_left"] * 2


def test_parts_have_their_own_sizes(spark):
    rows = [(1, 2, "world", 9), (1, 1, "hello", 4), (1, 3, "x", -1), (1, 4, "y", None), (2, 1, "\u00e9\u00e8z", 2)]
    got = shapes.joined_parts(spark.createDataFrame(rows, "k long, o long, t string, n long"), "k", "o", "t", "n").collect()
    assert sorted(tuple(r) for r in got) == [(1, "hellworld", 4, 9), (2, "\u00e9\u00e8", 1, 2)]
