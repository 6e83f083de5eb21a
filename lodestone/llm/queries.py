"""The operators as queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import table

from . import bpe, exact_dedup, lm, mixing, ngram_join, quality, suffix_dedup, token_counts, topk, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL["op1_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


#: A block list for the captures: a quarter of all hosts and parent domains, each listed, lifted
#: and listed again on days that its hash fixes.
LISTED = "h % 4 = 0"


def block_list(pages: DataFrame) -> DataFrame:
    """The dated log (entry, action, dated) over every host and parent domain of pages."""
    names = pages.select(F.explode(url_filter.suffixes(url_filter.host_of(F.col("url")))).alias("entry")).distinct()
    h = F.conv(F.substring(F.md5(F.col("entry").cast("binary")), 1, 8), 16, 10).cast("long")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    log = F.array(
        F.struct(F.lit("add").alias("action"), day(F.col("h") % 200).alias("dated")),
        F.struct(F.lit("remove").alias("action"), day(F.col("h") % 200 + 30 + F.col("h") % 60).alias("dated")),
        F.struct(F.lit("add").alias("action"), day(F.col("h") % 200 + 120).alias("dated")),
    )
    return names.withColumn("h", h).filter(LISTED).select("entry", F.inline(log))


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(365)).cast("int"))
    return url_filter.filter_captures(pages.withColumn("fetched_on", fetched), block_list(pages))


ORACLE_SQL["op3_url_filters"] = r"""
WITH c AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1)) AS host,
         DATE '2024-01-01' + ((page_id * 7919) % 365)::INTEGER AS fetched_on
  FROM pages),
keys AS (
  SELECT page_id, host, fetched_on, unnest(list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) AS entry
  FROM c WHERE host <> ''),
names AS (SELECT DISTINCT entry, ('0x' || substr(md5(entry), 1, 8))::BIGINT AS h FROM keys),
spans AS (
  SELECT entry, DATE '2024-01-01' + (h % 200)::INTEGER AS valid_from, DATE '2024-01-01' + (h % 200 + 30 + h % 60)::INTEGER AS valid_to FROM names WHERE h % 4 = 0
  UNION ALL
  SELECT entry, DATE '2024-01-01' + (h % 200 + 120)::INTEGER, NULL FROM names WHERE h % 4 = 0),
hits AS (
  SELECT page_id, count(*) AS n_active, max(struct_pack(n := length(keys.entry), e := keys.entry)).e AS matched
  FROM keys JOIN spans ON keys.entry = spans.entry AND fetched_on >= valid_from AND (valid_to IS NULL OR fetched_on < valid_to)
  GROUP BY page_id)
SELECT c.page_id, host, fetched_on, coalesce(n_active, 0) AS n_active, matched, n_active IS NOT NULL AS blocked
FROM c LEFT JOIN hits USING (page_id)
"""


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL["op7_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "source", "lang", "topic", "n_tokens", F.round("factor", 6).alias("factor"), F.round("prob", 6).alias("prob"), "sampled")


@query
def op9_mixing_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9_mixing, with documents repeated where a cell needs more than all of them; raked for the 40 rounds of its SQL, and on where these leave a share too far off."""
    out = mixing.mix(table(spark, sf_dir, "documents"), way="copies", least=40)
    return out.select("doc.doc_id", "source", "lang", "topic", "n_tokens", F.round("factor", 6).alias("factor"), F.round("prob", 6).alias("expected"), "copies")


def _raking_sql(rounds: int = mixing.ROUNDS, copies: bool = False) -> str:
    steps = ["w0 AS (SELECT *, tokens / (SELECT sum(tokens) FROM cells)::DOUBLE AS w FROM cells)"]
    n = 0
    for _ in range(rounds):
        for d in mixing.DIMS:
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN sum(w) OVER p > 0 THEN w * t_{d}.share / sum(w) OVER p ELSE 0 END AS w FROM w{n} JOIN t_{d} USING ({d}) WINDOW p AS (PARTITION BY {d}))")
            n += 1
    targets = ", ".join(f"r_{d} AS (SELECT {d}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens)::DOUBLE, 0.5) ELSE 0 END AS s FROM cells GROUP BY {d}), t_{d} AS (SELECT {d}, s / sum(s) OVER () AS share FROM r_{d})" for d in mixing.DIMS)
    head = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '<null>') AS source, coalesce(lang, '<null>') AS lang,
         CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'shouting'
              WHEN contains(text, '%%% ') OR contains(text, '$$$ ') THEN 'symbols' ELSE 'prose' END AS topic,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{targets},
{", ".join(steps)},
f AS (SELECT *, CASE WHEN tokens > 0 THEN w * (SELECT sum(tokens) FROM cells) / tokens ELSE 0 END AS factor FROM w{n})"""
    if copies:
        return rf"""{head}
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(factor, 6) AS factor, round(0.5 * factor, 6) AS expected,
       (floor(0.5 * factor) + (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.5 * factor - floor(0.5 * factor))::INTEGER)::BIGINT AS copies
FROM d JOIN f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic
"""
    return rf"""{head},
o AS (
  SELECT *, 0.5 * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(tokens * factor) OVER (ORDER BY factor DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass,
         row_number() OVER (ORDER BY factor DESC, source, lang, topic) AS i
  FROM f),
k AS (SELECT rest / mass AS k FROM o WHERE mass > 0 AND rest / mass * factor <= 1 ORDER BY i LIMIT 1)
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(factor, 6) AS factor, round(least(1.0, k * factor), 6) AS prob,
       ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < least(1.0, k * factor) AS sampled
FROM d JOIN f ON d.source = f.source AND d.lang = f.lang AND d.topic = f.topic, k
"""


ORACLE_SQL["op9_mixing"] = _raking_sql()
#: Rounds after which raking no longer moves at the given sizes, as SQL does not look at the residual.
ORACLE_SQL["op9_mixing_copies"] = _raking_sql(40, copies=True)


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.over_limit(token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")), 2048)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = quality.bucket_of(F.col("doc_id"), 4)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 2)
    out = quality.scored(docs, model)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), t=0.75, n=5)


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = quality.bucket_of(F.col("doc_id"), 7)
    return lm.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), fold != 2, fold == 2)


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=50)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
