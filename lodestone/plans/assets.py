"""Queries over the given tables as assets: documents, schemas, handlers, integrity, geometry and audio, each with its SQL twin."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import audio, geometry, numeric, texts
from lodestone.operators import dispatch, documents, entries, integrity, lookups, schemas, shapes
from lodestone.session import table, work_dir
from lodestone.sources import pak

from .catalog import CATALOG, EXT, EXTENSIONS, catalog, query

DOC = """'{"summary":{"names":["' || event_type || '","b"],"count":' || user_id || '},"exports":[{"object_name":"e' || event_id || '"},{"object_name":"f","0":true}],"props":' || props || '}'"""


def inspected(events: DataFrame) -> DataFrame:
    """events as documents (event_id, doc): the given JSON inside a package's summary and exports."""
    parts = [F.lit('{"summary":{"names":["'), "event_type", F.lit('","b"],"count":'), F.col("user_id").cast("string"), F.lit('},"exports":[{"object_name":"e'), F.col("event_id").cast("string"), F.lit('"},{"object_name":"f","0":true}],"props":'), "props", F.lit("}")]
    return events.select("event_id", F.parse_json(F.concat(*parts)).alias("doc"))


@query(f"""WITH d AS (SELECT event_id, ({DOC})::JSON AS d FROM events)
SELECT event_id, json_extract_string(d, '$.summary.count')::BIGINT AS n, json_extract_string(d, '$.exports[0].object_name') AS name, json_extract_string(d, '$.props.k')::BIGINT AS k, json_extract_string(d, '$.exports[1]."0"')::BOOLEAN AS flag, NULL::VARCHAR AS nowhere FROM d""")
def document_navigate(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda p, kind: F.try_variant_get(documents.navigate(F.col("doc"), p), "$", kind)
    docs = inspected(table(spark, sf_dir, "events"))
    return docs.select("event_id", at(".summary..count", "bigint").alias("n"), at("exports.0.object_name", "string").alias("name"), at("props.k", "bigint").alias("k"), at("exports.1.0", "boolean").alias("flag"), at("summary.names.x.1", "string").alias("nowhere"))


@query(f"""WITH d AS (SELECT event_id, ({DOC})::JSON AS d, props FROM events WHERE props IS NOT NULL),
r AS (SELECT event_id, '' AS path, 0 AS depth, '[3]' AS value FROM d
UNION ALL SELECT event_id, 'exports', 1, '[2]' FROM d UNION ALL SELECT event_id, 'props', 1, '[1]' FROM d UNION ALL SELECT event_id, 'summary', 1, '[2]' FROM d
UNION ALL SELECT event_id, 'props/k', 2, json_extract(props, '$.k')::VARCHAR FROM d
UNION ALL SELECT event_id, 'summary/count', 2, json_extract(d, '$.summary.count')::VARCHAR FROM d UNION ALL SELECT event_id, 'summary/names', 2, '[2]' FROM d)
SELECT event_id, path, depth, value FROM r""")
def document_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each document's tree with its exports left closed."""
    docs = inspected(table(spark, sf_dir, "events").filter("props IS NOT NULL"))
    rows = documents.flatten(docs, "event_id", "doc", F.col("label") != "exports", depth=2, cap=100)
    return rows.select("event_id", F.array_join(F.transform("path", lambda s: s["label"]), "/").alias("path"), "depth", "value")


@query("""WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS names, (['0', '99', 'user', 'assistant', 'nobody'])[conv_id % 5 + 1] AS sel FROM conversations GROUP BY conv_id),
h AS (SELECT *, try_cast(sel AS BIGINT) AS n, list_filter(range(0, len(names)), lambda i: names[i + 1] = sel) AS hits FROM c)
SELECT conv_id, CASE WHEN n IS NOT NULL THEN CASE WHEN n < len(names) THEN n END WHEN len(hits) = 1 THEN hits[1] END AS index,
CASE WHEN n IS NOT NULL THEN CASE WHEN n >= len(names) THEN 'out of range' END WHEN len(hits) = 0 THEN 'unknown' WHEN len(hits) > 1 THEN 'ambiguous' END AS fault FROM h""")
def export_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(names.alias("names"))
    wanted = F.element_at(F.array(*map(F.lit, ("0", "99", "user", "assistant", "nobody"))), (F.col("conv_id") % 5 + 1).cast("int"))
    return rows.select("conv_id", documents.select_export(F.col("names"), wanted).alias("s")).select("conv_id", "s.*")


@query("""SELECT user_id, min_by(value, event_id) AS value FROM events WHERE event_type = 'view' AND event_id % 3 = 0 GROUP BY user_id""")
def property_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("name"), (F.col("event_id") % 3).alias("array_index"), "value")
    return documents.first_property(rows, "user_id", "view", "event_id")


@query("""SELECT page_id, (i * 16)::INTEGER AS at, lower(hex(substr(url, i * 16 + 1, 16))) AS hex, regexp_replace(substr(url, i * 16 + 1, 16), '[^ -~]', '.', 'g') AS ascii
FROM (SELECT page_id, url, unnest(range(0, (strlen(url) + 15) // 16)) AS i FROM pages WHERE url IS NOT NULL)""")
def hex_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.inline(documents.hex_rows(F.col("url").cast("binary"))))
    return rows.select("page_id", F.col("offset").alias("at"), F.lower(F.hex("bytes")).alias("hex"), texts.ascii_text(F.col("bytes")).alias("ascii"))


@query(f"""WITH {CATALOG}, e AS (SELECT path, 'a.pak' AS source FROM cat WHERE doc_id % 2 = 0 UNION ALL SELECT path, 'b.pak' FROM cat WHERE doc_id % 3 = 0),
h AS (SELECT path, count(DISTINCT source) AS n, min(source) AS s FROM e GROUP BY path)
SELECT cat.path AS path, CASE WHEN n = 1 THEN s END AS archive, CASE WHEN n IS NULL THEN 'none' WHEN n > 1 THEN 'ambiguous' END AS fault FROM cat LEFT JOIN h USING (path)""")
def archive_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = catalog(table(spark, sf_dir, "documents")).select("doc_id", "path")
    both = entries.union_sources({"a.pak": cat.filter("doc_id % 2 = 0").select("path"), "b.pak": cat.filter("doc_id % 3 = 0").select("path")})
    return dispatch.containing_archive(cat.select("path"), both, "path", "source")


STATES = ("verified", "not_present", "skipped_no_hash", "skipped_encrypted")


@query(f"""WITH e AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderkey % 50 = 0) AS skipped FROM orders GROUP BY 1),
a AS (SELECT c_custkey, ({list(STATES)})[[1, 1, 1, 3][c_custkey % 4 + 1]] AS main, ({list(STATES)})[c_custkey % 3 + 1] AS fdi, ({list(STATES)})[c_custkey % 7 % 4 + 1] AS phi, c_custkey % 5 > 0 AS claims, coalesce(verified, 0) AS verified, coalesce(skipped, 0) AS skipped FROM customer LEFT JOIN e ON c_custkey = o_custkey)
SELECT c_custkey, claims, CASE WHEN main <> 'verified' THEN main WHEN fdi NOT IN ('verified', 'not_present') THEN fdi WHEN phi NOT IN ('verified', 'not_present') THEN phi ELSE 'verified' END AS worst,
main = 'verified' AND fdi IN ('verified', 'not_present') AND phi IN ('verified', 'not_present') AND skipped = 0 AND verified > 0 AS fully_verified FROM a""")
def archive_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = lambda i: F.element_at(F.array(*map(F.lit, STATES)), i.cast("int"))
    k = F.col("c_custkey")
    skipped = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderkey") % 50 == 0)
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("verified"), F.count_if(skipped).alias("skipped"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").fillna(0, ["verified", "skipped"])
    rows = rows.select("*", state(F.when(k % 4 == 3, 3).otherwise(1)).alias("main"), state(k % 3 + 1).alias("fdi"), state(k % 7 % 4 + 1).alias("phi"), F.when(k % 5 > 0, F.sha1(k.cast("string"))).otherwise("0" * 40).alias("hash"))
    regions = [F.col("fdi"), F.col("phi")]
    return rows.select("c_custkey", integrity.claims_integrity(F.col("hash")).alias("claims"), integrity.worst_of(F.col("main"), *regions).alias("worst"), integrity.fully_verified(F.col("main"), regions, F.col("verified"), F.col("skipped")).alias("fully_verified"))


@query("SELECT conv_id, sha1(string_agg(text, '' ORDER BY turn, text)) AS sha1, count(*) AS n_blocks FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def block_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").select("conv_id", "turn", F.col("text").cast("binary").alias("data"))
    return integrity.hash_of_blocks(rows, "conv_id", "turn", "data")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, 90 AS declared FROM lineitem),
w AS (SELECT *, (sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q ROWS UNBOUNDED PRECEDING))::BIGINT AS written, lead(1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q) IS NULL AS last FROM b)
SELECT l_orderkey, l_linenumber, written, CASE WHEN written > declared THEN 'overrun' WHEN last AND written < declared THEN 'short' END AS fault FROM w""")
def block_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.lit(90).alias("declared"))
    return integrity.cumulative_size(rows, "l_orderkey", ["l_linenumber", "q"], "q", "declared").drop("q", "declared")


@query("""WITH p AS (SELECT o_orderstatus AS archive, 'f' || o_custkey AS name, count(*) AS n FROM orders GROUP BY ALL)
SELECT archive, sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates, coalesce(list_sort(list(name) FILTER (n > 1))[1:5], []) AS sample FROM p GROUP BY archive""")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("archive"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("name"))
    return integrity.duplicates(rows, "archive", "name")


def world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations, regions and the world as classes (class, super, prop_count), and their properties (class, schema_index, name)."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    classes = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("class"), F.col("r_name").alias("super"), F.lit(3).alias("prop_count"))
    classes = classes.union(region.select("r_name", F.lit("World"), F.lit(5))).union(spark.createDataFrame([("World", "", 2)], classes.schema))
    indexed = classes.select("class", F.explode(F.sequence(F.lit(0), F.col("prop_count") - 1)).alias("schema_index"))
    return classes, indexed.select("class", "schema_index", F.concat(F.left("class", F.lit(3)), F.col("schema_index").cast("string")).alias("name"))


@query("""WITH c(class, super, n, depth0) AS (SELECT n_name, r_name, 3, 0 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'World', 5, 0 FROM region UNION ALL SELECT 'World', '', 2, 0),
k AS (SELECT class AS root, class AS node, 0 AS depth, 0 AS off FROM c UNION ALL SELECT a.class, a.super, 1, a.n FROM c a WHERE a.super <> '' UNION ALL SELECT a.class, b.super, 2, a.n + b.n FROM c a JOIN c b ON a.super = b.class WHERE b.super <> '')
SELECT root AS class, off + i AS slot, node AS from_class, depth, i::INTEGER AS schema_index, left(node, 3) || i AS name, false AS truncated FROM (SELECT k.*, unnest(range(0, n)) AS i FROM k JOIN c ON k.node = c.class)""")
def schema_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.flattened_slots(*world(spark, sf_dir))


@query("""SELECT c_custkey, coalesce(r_name, n_name, c_nationkey::VARCHAR) AS label FROM (SELECT c_custkey, c_nationkey, c_nationkey * 2 % 40 AS o, c_custkey % 2 AS e FROM customer)
LEFT JOIN region ON e = 0 AND r_regionkey = c_nationkey LEFT JOIN nation ON e = 1 AND n_nationkey = c_nationkey AND n_nationkey < 20""")
def enum_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(F.lit("region").alias("enum"), F.col("r_regionkey").alias("ordinal"), F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.lit("nation"), "n_nationkey", "n_name")
    values = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, "region").otherwise("nation").alias("enum_name"))
    return schemas.enum_names(values, region.union(nation), "enum_name", "c_nationkey").select("c_custkey", "label")


@query("""WITH k AS (SELECT CASE WHEN s_suppkey = 1 THEN repeat('0', 32) ELSE md5(s_suppkey::VARCHAR) END AS guid, s_name AS key FROM supplier),
a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN md5((c_custkey % 40)::VARCHAR) END AS guid FROM customer)
SELECT c_custkey, coalesce(k.key, z.key) AS key FROM a LEFT JOIN k ON a.guid = k.guid LEFT JOIN k z ON z.guid = repeat('0', 32)""")
def guid_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    guid = F.when(F.col("s_suppkey") == 1, texts.ZERO_GUID).otherwise(F.md5(F.col("s_suppkey").cast("string")))
    keys = table(spark, sf_dir, "supplier").select(guid.alias("guid"), F.col("s_name").alias("key"))
    archives = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.md5((F.col("c_custkey") % 40).cast("string"))).alias("archive_guid"))
    return schemas.keys_by_guid(archives, keys, "archive_guid", texts.ZERO_GUID).select("c_custkey", "key")


_PACKED = "((l_partkey % 6) | (CASE WHEN l_suppkey % 3 = 0 THEN 128 ELSE 0 END) | ((l_quantity::BIGINT % 9) << 9))"


@query(f"""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS i, {_PACKED} AS p FROM lineitem),
x AS (SELECT k, i, p, p & 127 AS skip, (p >> 9) & 127 AS n, (p & 128) <> 0 AS z FROM f),
r AS (SELECT k, i, z, sum(skip + n) OVER w - n AS first, sum(skip + n) OVER w AS stop, CASE WHEN z THEN sum(CASE WHEN z THEN n ELSE 0 END) OVER w - n ELSE 0 END AS base FROM x WINDOW w AS (PARTITION BY k ORDER BY i, p ROWS UNBOUNDED PRECEDING)),
s AS (SELECT o_orderkey AS k, unnest([0, 3, 7, 12, 20, 31]) AS slot, md5(o_orderkey::VARCHAR) AS mask FROM orders)
SELECT s.k AS o_orderkey, s.slot AS slot, r.k IS NOT NULL AND (NOT z OR (base + slot - first < 128 AND (('0x' || substr(mask, ((base + slot - first) // 8 * 2 + 1)::BIGINT, 2))::INTEGER >> ((base + slot - first) % 8)::INTEGER) & 1 = 0)) AS present
FROM s LEFT JOIN r ON s.k = r.k AND slot >= first AND slot < stop""")
def slots_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = (F.col("l_partkey") % 6).bitwiseOR(F.when(F.col("l_suppkey") % 3 == 0, 128).otherwise(0)).bitwiseOR(F.shiftleft(F.col("l_quantity").cast("long") % 9, 9))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", packed.alias("packed"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    masks = orders.select("o_orderkey", F.unhex(F.md5(F.col("o_orderkey").cast("string"))).alias("mask"))
    slots = orders.select("o_orderkey", F.explode(F.array(*map(F.lit, (0, 3, 7, 12, 20, 31)))).alias("slot"))
    return schemas.slot_present(slots, schemas.fragment_ranges(parts, "o_orderkey", ["l_linenumber", "packed"], "packed"), masks, "o_orderkey", "slot")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, (l_partkey % 60)::INTEGER AS tile, [5, 10, 20, 40] AS f, (l_suppkey % 4)::INTEGER AS chunks, (l_quantity::BIGINT - 4) AS local, [3, 1, 99, 0, 2] AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN len(list_filter(f, lambda x: x <= tile)) = 0 THEN greatest(chunks - 1, 0) ELSE least(len(list_filter(f, lambda x: x <= tile)) - 1, greatest(chunks - 1, 0)) END::INTEGER AS chunk,
CASE WHEN local >= 0 AND m[local + 1] < 50 THEN m[local + 1] END::INTEGER AS bone FROM t""")
def bucket_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = schemas.bucket_of(F.array(*map(F.lit, (5, 10, 20, 40))), (F.col("l_partkey") % 60).cast("int"), (F.col("l_suppkey") % 4).cast("int"))
    bone = schemas.global_bone(F.array(*map(F.lit, (3, 1, 99, 0, 2))), F.col("l_quantity").cast("long") - 4, F.lit(50))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", chunk.alias("chunk"), bone.alias("bone"))


#: Handlers in order of registration: (variant, ext, ord, handler, least size that it supports).
HANDLERS = (("uasset", "glb", 0, "mesh", 2000), ("uasset", "json", 1, "table", 300), ("uasset", "json", 2, "any", 0), ("umap", "glb", 3, "map", 500), ("locres", "csv", 4, "strings", 0), ("locres", "json", 5, "tree", 0), ("txt", "txt", 6, "raw", 100))
_HANDLERS = "h(variant, ext, ord, handler, least) AS (VALUES " + ", ".join(map(str, HANDLERS)) + ")"


def handlers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HANDLERS), "variant string, ext string, ord int, handler string, least long")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    variant = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.col("n_chars").alias("size"), variant.alias("variant"))


_ASSETS = f"a AS (SELECT doc_id, source, n_chars AS size, ({list(EXTENSIONS)})[doc_id % 6 + 1] AS variant FROM documents)"


@query(f"""WITH {_HANDLERS}, {_ASSETS} SELECT doc_id, min_by(handler, ord) AS handler, min_by(ext, ord) AS ext, min_by(handler, ord) FILTER (ext = 'json') AS json_handler FROM a JOIN h ON a.variant = h.variant AND size >= least GROUP BY doc_id""")
def handler_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fits = assets(spark, sf_dir), F.col("size") >= F.col("least")
    first = dispatch.first_handlers(rows, handlers(spark), ["doc_id"], fits)
    json = dispatch.first_handlers(rows.withColumn("wanted", F.lit("json")), handlers(spark), ["doc_id"], fits, wanted="wanted")
    return first.join(json.select("doc_id", F.col("handler").alias("json_handler")), "doc_id", "left")


@query(f"""WITH {_HANDLERS}, {_ASSETS}, f AS (SELECT source, doc_id, min_by(handler, ord) AS handler, min_by(ext, ord) AS ext FROM a JOIN h ON a.variant = h.variant AND size >= least GROUP BY ALL)
SELECT source, min(doc_id) AS doc_id, min_by(handler, doc_id) AS handler, min_by(ext, doc_id) AS ext FROM f GROUP BY source""")
def first_exportable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dispatch.first_handlers(assets(spark, sf_dir), handlers(spark), ["source", "doc_id"], F.col("size") >= F.col("least"))
    return dispatch.first_exportable(rows, "source", "doc_id")


@query(f"""WITH {_HANDLERS}, {_ASSETS} SELECT doc_id, ext, min(ord) AS ord FROM a JOIN h ON a.variant = h.variant AND size >= least GROUP BY ALL""")
def format_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.formats(assets(spark, sf_dir), handlers(spark), ["doc_id"], F.col("size") >= F.col("least"))


@query(f"""WITH {_ASSETS} SELECT doc_id, CASE variant WHEN 'uasset' THEN 'package' WHEN 'umap' THEN 'level' WHEN 'locres' THEN 'strings' ELSE 'generic' END AS reader FROM a""")
def class_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("uasset", "package"), ("umap", "level"), ("locres", "strings")], "class string, reader string")
    return dispatch.readers(assets(spark, sf_dir).select("doc_id", "variant"), known, "variant").select("doc_id", "reader")


@query("""WITH l AS (SELECT s_nationkey AS id, min(s_name) AS name, max(s_acctbal) AS v FROM supplier GROUP BY 1),
r AS (SELECT c_nationkey AS id, min_by(c_name, c_custkey) AS name, min_by(c_acctbal, c_custkey) AS v FROM customer WHERE c_nationkey NOT IN (SELECT id FROM l) GROUP BY 1)
SELECT id, name, v, 'local' AS layer FROM l WHERE v > 2000 UNION ALL SELECT id, name, v, 'registry' FROM r WHERE v > 2000""")
def detect_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.min("s_name").alias("name"), F.max("s_acctbal").alias("v"))
    registry = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"), F.col("c_custkey").alias("ord"))
    return dispatch.detected(local, registry, "id", "ord", F.col("v") > 2000)


@query("""SELECT p_partkey, min(CASE WHEN (CASE WHEN b = 0 THEN 0 ELSE greatest(b >> l, 1) END) * greatest(b >> l, 1) * 4 <= 4096 THEN l END)::INTEGER AS level FROM (SELECT p_partkey, p_size * 64 AS b, unnest(range(0, 8)) AS l FROM part) GROUP BY p_partkey""")
def level_that_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 64).alias("base"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("l"))
    side = geometry.mip_size(F.col("base"), F.col("l"))
    return dispatch.best_level(levels, "p_partkey", "l", side * side * 4, 4096)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, ([1, 256, 2304, 257, 16, 513, 65537, 65792, 524288, 0])[l_partkey % 10 + 1] AS f, l_suppkey - 50 AS o, 10 AS header, -20 AS shift FROM lineitem),
t AS (SELECT *, CASE WHEN f & 65536 <> 0 THEN o ELSE o + shift END AS "at" FROM b),
x AS (SELECT *, CASE WHEN f & 524288 <> 0 THEN 'unknown flags' WHEN f & 16 <> 0 THEN 'lzo' WHEN f & 512 <> 0 THEN 'bitwindow' WHEN "at" < 0 THEN 'offset' WHEN f & 256 <> 0 AND f & 1 <> 0 THEN 'conflicting tiers' WHEN f & 257 = 0 THEN 'no tier' END AS fault FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN fault IS NULL THEN CASE WHEN f & 256 <> 0 THEN CASE WHEN f & 2048 <> 0 THEN 'uptnl' ELSE 'ubulk' END WHEN "at" < header THEN 'inline' ELSE 'uexp' END END AS tier, CASE WHEN fault IS NULL THEN "at" END AS "at", fault FROM x""")
def bulk_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 256, 2304, 257, 16, 513, 65537, 65792, 524288, 0)]), (F.col("l_partkey") % 10 + 1).cast("int"))
    tier = geometry.bulk_tier(flags, F.col("l_suppkey") - 50, F.lit(10), F.lit(-20))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tier.alias("t")).select("l_orderkey", "l_linenumber", "t.*")


@query("""WITH v AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'UE' WHEN 1 THEN 'ue ' WHEN 2 THEN ' ' ELSE '' END || p_size || '.' || p_partkey % 30 || CASE p_partkey % 4 WHEN 0 THEN '.' || p_size WHEN 1 THEN '.x' ELSE '' END AS t FROM part),
p AS (SELECT *, regexp_extract(trim(t), '^(?:[Uu][Ee])?\\s*(\\d+)\\.(\\d+)(?:\\.(\\d+))?$', ['a', 'b', 'c']) AS m FROM v)
SELECT p_partkey, try_cast(m.a AS BIGINT) AS major, try_cast(m.b AS BIGINT) AS minor, try_cast(m.c AS BIGINT) AS patch,
CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE coalesce((m.a <> '') AND (m.a::BIGINT > 20 OR (m.a::BIGINT = 20 AND m.b::BIGINT >= 5)), false) END AS gate FROM p""".replace("m.a::BIGINT", "try_cast(m.a AS BIGINT)").replace("m.b::BIGINT", "try_cast(m.b AS BIGINT)"))
def engine_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.concat(F.when(k % 6 == 0, "UE").when(k % 6 == 1, "ue ").when(k % 6 == 2, " ").otherwise(""), s, F.lit("."), (k % 30).cast("string"), F.when(k % 4 == 0, F.concat(F.lit("."), s)).when(k % 4 == 1, ".x").otherwise(""))
    verdict = F.when(k % 3 == 0, "asserts").when(k % 3 == 1, "denies").otherwise("ambiguous")
    rows = table(spark, sf_dir, "part").select("p_partkey", texts.version(text).alias("v"), verdict.alias("verdict"))
    return rows.select("p_partkey", "v.major", "v.minor", "v.patch", texts.engine_gate(F.col("verdict"), F.col("v"), 20, 5).alias("gate"))


@query("""WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '0x' || upper(md5(c_name)) WHEN 1 THEN md5(c_name) WHEN 2 THEN left(md5(c_name), 30) WHEN 3 THEN 'xyz' ELSE left(md5(c_name), 7) END AS t, c_name || ' ' || c_mktsegment || ' ' || md5(c_name) || md5(c_mktsegment) AS long FROM customer)
SELECT c_custkey, CASE WHEN regexp_matches(t, '^([0-9A-Fa-f]{2})+$') THEN lower(t) END AS bytes, CASE WHEN c_custkey % 5 < 2 THEN lower(right(t, 32)) END AS guid, CASE WHEN c_custkey % 5 < 2 THEN lower(right(t, 32)) ELSE 'default' END AS shown,
CASE WHEN length(long) > 64 THEN left(long, 64) || '…' ELSE long END AS short, left(md5(t), 16) || '...' AS digest FROM t""")
def hex_and_guids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, m = F.col("c_custkey"), F.md5("c_name")
    text = F.when(k % 5 == 0, F.concat(F.lit("0x"), F.upper(m))).when(k % 5 == 1, m).when(k % 5 == 2, F.left(m, F.lit(30))).when(k % 5 == 3, "xyz").otherwise(F.left(m, F.lit(7)))
    long = F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" "), m, F.md5("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", text.alias("t"), long.alias("long"))
    guid = texts.guid_hex(F.col("t"))
    return rows.select("c_custkey", F.lower(F.hex(texts.hex_bytes(F.col("t")))).alias("bytes"), guid.alias("guid"), texts.display_guid(F.unhex(guid)).alias("shown"), texts.shortened(F.col("long")).alias("short"), texts.short_digest(F.unhex(F.md5("t"))).alias("digest"))


@query(f"""WITH e AS (SELECT event_id, ({list(texts.LEVELS)})[user_id % 5 + 1] AS level, user_id % 5 AS n, event_type AS target, props AS message, ts FROM events),
s AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM e)
SELECT event_id, rpad(level, 5, ' ') || ' ' || target || ' ' || message AS line FROM s WHERE n <= 2 AND contains(target, 'i') AND contains(message, '1')""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, texts.LEVELS)), (F.col("user_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", level.alias("level"), F.col("event_type").alias("target"), F.col("props").alias("message"))
    cols = [F.col(c) for c in ("level", "target", "message")]
    return rows.filter(texts.log_passes(*cols, most="INFO", target_part="i", message_part="1")).select("event_id", texts.log_line(*cols).alias("line"))


@query("""WITH v AS (SELECT event_id, event_id % 5 AS m, floor(value)::BIGINT AS n, event_type AS t, props FROM events)
SELECT event_id, CASE m WHEN 0 THEN n::VARCHAR WHEN 1 THEN t WHEN 2 THEN 'Red' WHEN 3 THEN props ELSE '["' || t || '",1]' END AS cell,
CASE m WHEN 0 THEN n::VARCHAR WHEN 1 THEN '"' || t || '"' WHEN 2 THEN t || '::Red' WHEN 3 THEN '<null>' ELSE '[2]' END AS line FROM v""")
def property_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, t = F.col("event_id") % 5, F.col("event_type")
    kind = F.when(m == 0, "Int").when(m == 1, "Str").when(m == 2, "Enum").when(m == 3, "Object").otherwise("Array")
    quoted = F.concat(F.lit('"'), t, F.lit('"'))
    value = F.when(m == 0, F.floor("value").cast("string")).when(m == 1, quoted).when(m == 2, F.concat(F.lit('{"type":'), quoted, F.lit(',"value":"Red"}'))).when(m == 3, F.col("props")).otherwise(F.concat(F.lit("["), quoted, F.lit(",1]")))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), value.alias("value"))
    return rows.select("event_id", texts.cell_text(F.col("kind"), F.col("value")).alias("cell"), texts.scalar_text(F.col("kind"), F.col("value")).alias("line"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, [l_partkey % 256, l_suppkey % 256, l_quantity::BIGINT, CASE WHEN l_linenumber % 2 = 0 THEN 255 ELSE l_orderkey % 256 END] AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, '#' || upper(lpad(to_hex(c[1]), 2, '0')) || upper(lpad(to_hex(c[2]), 2, '0')) || upper(lpad(to_hex(c[3]), 2, '0')) || CASE WHEN c[4] = 255 THEN '' ELSE upper(lpad(to_hex(c[4]), 2, '0')) END AS colour, [c[2], c[2], c[2], 255] AS green, [c[1], 0, c[3], 255] AS purple FROM p""")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_quantity").cast("long"), F.when(F.col("l_linenumber") % 2 == 0, 255).otherwise(F.col("l_orderkey") % 256).cast("long")]
    px = F.array(*c)
    long = lambda a: a.cast("array<bigint>")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", texts.colour_hex(*c).alias("colour"), long(geometry.masked_pixel(px, "g")).alias("green"), long(geometry.masked_pixel(px, "rb")).alias("purple"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS v FROM embeddings), n AS (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) AS n FROM v)
SELECT vec_id, [round(v[1] * 0.01::DOUBLE, 9), round(v[3] * 0.01::DOUBLE, 9), round(v[2] * 0.01::DOUBLE, 9)] AS position, [round(v[1] / n, 6), round(v[3] / n, 6), round(v[2] / n, 6), round(-v[4], 6)] AS tangent, true AS finite FROM n""")
def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    rounded = lambda a, n: F.transform(a, lambda x: numeric.rounded(x, n))
    return rows.select("vec_id", rounded(geometry.position(F.col("v")), 9).alias("position"), rounded(geometry.tangent(F.col("v")), 6).alias("tangent"), geometry.finite(F.col("v")).alias("finite"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, [l_partkey * 7919 % 65536, l_suppkey * 104729 % 65536, l_orderkey % 65536, 65535] AS w, [l_partkey % 9, l_suppkey % 9, l_orderkey % 9, l_linenumber, 2] AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, list_transform(w, lambda x: round((xor(x, 32768)::DOUBLE - 32767.5::DOUBLE) / 32767.5::DOUBLE, 9)) AS packed, CASE WHEN list_max(i) < 8 THEN [i[1], i[3], i[2], i[4], i[5]] END AS turned,
greatest(l_linenumber - 3, 0)::BIGINT AS first, (greatest(least(greatest(l_linenumber - 3, 0) + 6, 7) - greatest(l_linenumber - 3, 0), 0) // 3 * 3)::BIGINT AS length FROM w""")
def index_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.array(F.col("l_partkey") * 7919 % 65536, F.col("l_suppkey") * 104729 % 65536, F.col("l_orderkey") % 65536, F.lit(65535).cast("long"))
    i = F.array(F.col("l_partkey") % 9, F.col("l_suppkey") % 9, F.col("l_orderkey") % 9, F.col("l_linenumber").cast("long"), F.lit(2).cast("long"))
    span = geometry.section_span(F.col("l_linenumber") - 3, F.lit(2), F.lit(7))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w"), i.alias("i"), span.alias("s"))
    return rows.select("l_orderkey", "l_linenumber", F.transform(geometry.packed_rgba16(F.col("w")), lambda x: F.round(x, 9)).alias("packed"), geometry.reverse_winding_within(F.col("i"), F.lit(8)).alias("turned"), "s.first", "s.length")


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN 0 ELSE greatest((p_size * 16) >> (p_partkey % 12)::INTEGER, 1) END::BIGINT AS side,
CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN CASE WHEN p_size % 8 = 6 THEN 6 END WHEN 2 THEN CASE WHEN p_size % 5 >= 1 THEN p_size % 5 END ELSE p_size END::BIGINT AS slices, p_size & 1 <> 0 AS editor_stripped, p_size & 2 <> 0 AS av_stripped,
(p_size * 72 + p_size * 2 * 8 + CASE WHEN p_size % 2 = 0 THEN p_size * 4 ELSE 0 END + p_size * 12)::BIGINT AS bytes, CASE WHEN p_size % 3 = 0 THEN p_size * 10 ELSE least(p_size * 10, 256) END::BIGINT AS budget FROM part""")
def texture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    kind = F.when(k % 4 == 0, "2d").when(k % 4 == 1, "cube").when(k % 4 == 2, "array").otherwise("volume")
    packed = F.when(k % 4 == 1, (s % 8).bitwiseOR(1 << 30)).otherwise(s)
    side = geometry.mip_size(F.when(s == 1, 0).otherwise(s * 16), k % 12)
    return table(spark, sf_dir, "part").select("p_partkey", side.alias("side"), geometry.slice_count(kind, packed, F.when(k % 4 == 2, s % 5).otherwise(s)).alias("slices"), geometry.stripped(s, geometry.EDITOR_STRIPPED).alias("editor_stripped"), geometry.stripped(s, geometry.AV_STRIPPED).alias("av_stripped"), geometry.projected_bytes(s, F.lit(2), s % 2 == 0, s * 3).alias("bytes"), geometry.block_budget(s * 10, F.lit(256).cast("long"), s % 3 == 0).alias("budget"))


@query("""WITH RECURSIVE b AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, c_acctbal / 100 AS t, 1 + (c_custkey % 3) / 4.0::DOUBLE AS s FROM customer),
g(k, i, t, s) AS (SELECT k, i, t, s FROM b WHERE i = 0 UNION ALL SELECT b.k, b.i, g.t + g.s * b.t, g.s * b.s FROM g JOIN b ON b.k = g.k AND b.i > 0 AND (b.i - 1) // 2 = g.i)
SELECT k AS c_nationkey, i AS bone, round(1 / s, 9) AS scale, round(-t * 0.01::DOUBLE / s, 6) AS x FROM g""")
def bone_binds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse binds of a tree of bones without turns: its scale and its first translation."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    bones = table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_custkey", (F.row_number().over(w) - 1).cast("long").alias("bone"))
    s, zero = 1 + (F.col("c_custkey") % 3) / 4.0, F.lit(0.0)
    rows = bones.select("c_nationkey", "bone", F.when(F.col("bone") == 0, -1).otherwise(F.floor((F.col("bone") - 1) / 2)).alias("parent"), F.array(zero, zero, zero, F.lit(2.0)).alias("rotation"), F.array(F.col("c_acctbal") / 100, zero, zero).alias("translation"), F.array(s, s, s).alias("scale"))
    return geometry.inverse_binds(rows, "c_nationkey").select("c_nationkey", "bone", F.round(F.col("matrix")[0], 9).alias("scale"), F.round(F.col("matrix")[12], 6).alias("x"))


_BLOCK = "md5(c_custkey::VARCHAR) || md5(c_name)"


def _adpcm_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.unhex(F.concat(F.md5(F.col("c_custkey").cast("string")), F.md5("c_name"))).alias("raw"))


@query(f"""WITH RECURSIVE b AS (SELECT c_custkey AS k, {_BLOCK} AS h FROM customer),
c AS (SELECT k, (c_custkey % 1000 - 500)::INTEGER AS v0, (c_custkey % 89)::INTEGER AS a0, h FROM b JOIN customer ON k = c_custkey),
n AS (SELECT k, i, ('0x' || substr(h, (i // 2 * 2 + 2 - i % 2)::BIGINT, 1))::INTEGER AS code FROM (SELECT k, h, unnest(range(0, 64)) AS i FROM c)),
d(k, i, v, a) AS (SELECT k, 0::BIGINT, v0, a0 FROM c UNION ALL
  SELECT k, i, greatest(least(CASE WHEN code & 8 <> 0 THEN v - diff ELSE v + diff END, 32767), -32768)::INTEGER, greatest(least(a + ({list(numeric.IMA_INDEX)})[(code & 7) + 1], 88), 0)::INTEGER
  FROM (SELECT n.k AS k, d.i + 1 AS i, v, a, code, (s >> 3) + CASE WHEN code & 1 <> 0 THEN s >> 2 ELSE 0 END + CASE WHEN code & 2 <> 0 THEN s >> 1 ELSE 0 END + CASE WHEN code & 4 <> 0 THEN s ELSE 0 END AS diff
        FROM (SELECT *, ({list(numeric.IMA_STEPS)})[a + 1] AS s FROM d) d JOIN n ON n.k = d.k AND n.i = d.i))
SELECT k AS c_custkey, list(v ORDER BY i) AS samples FROM d GROUP BY k""")
def adpcm_ima_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(audio.little(F.pmod(F.col("c_custkey") % 1000 - 500, F.lit(65536)), 2), audio.little(F.col("c_custkey") % 89, 1), audio.little(F.lit(0), 1))
    return _adpcm_block(spark, sf_dir).select("c_custkey", audio.ima_samples(F.concat(head, "raw"), F.lit(1)).alias("samples"))


@query(f"""WITH RECURSIVE c AS (SELECT c_custkey AS k, {_BLOCK} AS h, (c_custkey % 7)::INTEGER AS p, (c_custkey % 300 + 16)::INTEGER AS delta, (c_custkey % 900 - 450)::INTEGER AS one, (c_custkey % 700 - 350)::INTEGER AS two FROM customer),
n AS (SELECT k, i, ('0x' || substr(h, (i + 1)::BIGINT, 1))::INTEGER AS code FROM (SELECT k, h, unnest(range(0, 64)) AS i FROM c)),
d(k, i, p, delta, one, two) AS (SELECT k, 0::BIGINT, p, delta, one, two FROM c UNION ALL
  SELECT k, i, p, greatest(least(({list(audio.MS_ADAPT)})[code + 1] * delta::BIGINT, 2147483647) // 256, 16)::INTEGER, greatest(least(trunc((one * c1 + two * c2) / 256.0::DOUBLE) + (code - CASE WHEN code >= 8 THEN 16 ELSE 0 END) * delta::BIGINT, 32767), -32768)::INTEGER, one
  FROM (SELECT n.k AS k, d.i + 1 AS i, p, delta, one, two, code, ({[c[0] for c in audio.MS_COEFFICIENTS]})[p + 1] AS c1, ({[c[1] for c in audio.MS_COEFFICIENTS]})[p + 1] AS c2 FROM d JOIN n ON n.k = d.k AND n.i = d.i))
SELECT d.k AS c_custkey, list_prepend(min(c.two), list(d.one ORDER BY i)) AS samples FROM d JOIN c ON d.k = c.k GROUP BY d.k""")
def adpcm_ms_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    word = lambda c: audio.little(F.pmod(c, F.lit(65536)), 2)
    head = F.concat(audio.little(k % 7, 1), word(k % 300 + 16), word(k % 900 - 450), word(k % 700 - 350))
    return _adpcm_block(spark, sf_dir).select("c_custkey", audio.ms_samples(F.concat(head, "raw"), F.lit(1)).alias("samples"))


@query("""WITH f AS (SELECT o_custkey AS k, o_orderkey AS i, (floor(o_totalprice)::BIGINT % 1000 + o_orderkey % 1000) / 2.0::DOUBLE AS mean FROM orders),
r AS (SELECT k, mean, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY k) AS n FROM f)
SELECT k AS o_custkey, j * least(n, 4) // n AS bucket, min(mean) AS low, max(mean) AS high FROM r GROUP BY ALL""")
def waveform_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    left, right = F.floor("o_totalprice") % 1000, F.col("o_orderkey") % 1000
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.row_number().over(w) - 1).alias("frame"), left.cast("double").alias("l"), right.cast("double").alias("r"))
    return shapes.waveform(rows, "o_custkey", "frame", ["l", "r"], 4)


@query(f"""WITH {CATALOG}, e AS (SELECT DISTINCT string_split(path, '/') AS p FROM cat), x AS (SELECT p, unnest(range(1, len(p) + 1)) AS depth FROM e),
n AS (SELECT array_to_string(p[1:depth], '/') AS node, p[1:depth] AS way, depth::INTEGER AS depth, bool_and(depth = len(p)) AS is_file FROM x GROUP BY ALL)
SELECT node, depth, is_file FROM n WHERE depth = 1 OR depth = 2 OR (depth = 3 AND way[2] = 'en') OR (depth = 4 AND way[2] = 'en' AND way[3] = 'src0')""")
def tree_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a tree with the folders Game, Game/en and Game/en/src0 open."""
    nodes = shapes.path_nodes(catalog(table(spark, sf_dir, "documents")))
    return shapes.shown(nodes, ["Game", "Game/en", "Game/en/src0"]).select("node", "depth", "is_file")


@query("""SELECT c_custkey, split_part(c_mktsegment || '_' || c_nationkey, '_', 1) AS codec, lower(c_mktsegment) IN ('building', 'machinery') AS supported, n.n_name AS name FROM customer JOIN nation n ON c_nationkey = n_nationkey""")
def codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = texts.codec_prefix(F.concat("c_mktsegment", F.lit("_"), F.col("c_nationkey").cast("string")))
    rows = table(spark, sf_dir, "customer").select("c_custkey", codec.alias("codec"), F.col("c_nationkey").alias("i"), F.lit(0).alias("k"))
    pool = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("name"))
    named = lookups.strict_names(rows, pool, "i", "k", out="name")
    return named.select("c_custkey", "codec", texts.supports_codec(F.col("codec"), ["Building", "MACHINERY"]).alias("supported"), "name")


@query("""SELECT a.n_name AS node, list_sort(list(b.c_custkey)) AS children FROM nation a JOIN customer b ON b.c_nationkey = a.n_nationkey GROUP BY 1""")
def child_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("node"))
    children = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("child"), F.col("c_nationkey").alias("parent"))
    return lookups.children_of(nodes, children).select("node", "children")


#: Documents in an archive that a query makes.
ARCHIVE = 200


def archives(spark: SparkSession, sf_dir: str) -> str:
    """documents as archives of ARCHIVE entries or fewer in a new folder that tasks can read; the glob that names them."""
    folder = f"{work_dir(spark)}/archives-{uuid.uuid4().hex}"
    rows = catalog(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")).select("doc_id", "path")
    rows = rows.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("archive", F.floor(F.col("doc_id") / ARCHIVE))

    def write(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("path")
        fs, root = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(root, recursive=True)
        name, data = int(t["archive"].iloc[0]), [(p, x.encode() if isinstance(x, str) else b"") for p, x in zip(t["path"], t["text"], strict=True)]
        part = f"{root}/{uuid.uuid4().hex}.part"
        with fs.open_output_stream(part) as f:
            f.write(pak.packed(data, compress=name % 2 == 0))
        fs.move(part, f"{root}/{name}.pak")  # a task that is run again replaces the same bytes
        return pd.DataFrame({"archive": [name], "n": [len(t)]})

    rows.groupBy("archive").applyInPandas(write, "archive long, n long").agg(F.sum("n")).first()
    return f"{folder}/*.pak"


@query(f"""WITH {CATALOG} SELECT path, strlen(coalesce(text, ''))::BIGINT AS size, doc_id // 200 % 2 = 0 AS compressed, sha1(coalesce(text, '')) AS content_sha1, doc_id // 200 % 2 = 1 OR NULL AS verified FROM cat JOIN documents USING (doc_id)""")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of archives made of documents, and their payloads by ranges; verified: of stored entries, whether the payload has the hash that the index claims."""
    pak.register(spark)
    rows = spark.read.format("pak").option("verifyIndex", "true").load(archives(spark, sf_dir))
    rows = pak.contents(rows, spread=16)
    verified = F.when(F.col("method") == "none", entries.verify_outcome(F.col("content"), F.col("sha1"), F.lit(True)) == "verified")
    return rows.select("path", "size", (F.col("method") == "zlib").alias("compressed"), F.sha1("content").alias("content_sha1"), verified.alias("verified"))


@query(f"""WITH {CATALOG} SELECT path, strlen(coalesce(text, ''))::BIGINT AS size FROM cat JOIN documents USING (doc_id) WHERE {EXT} IN ('uasset', 'umap') AND strlen(coalesce(text, '')) BETWEEN 256 AND 1048576""")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of archives' catalogs: no payload is read."""
    pak.register(spark)
    rows = spark.read.format("pak").load(archives(spark, sf_dir))
    return entries.search(rows, ext=["uasset", "umap"], glob="Game/**", min_size="256", max_size="1 MiB").select("path", "size")
