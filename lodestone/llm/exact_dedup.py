"""Exact dedup against a persistent digest index, DataFrame functions only.

The index is a Parquet table bucketed and sorted by digest. A batch is reduced to one row
per digest with a map-side combine (a group of copies, however large, leaves each task as one
row), the digests that the index lacks are found by a sort-merge anti-join that reads the index
without shuffling it, and those are appended.

Edge cases: a null text counts as empty; a null id loses every tie and is reported as it is;
rows that repeat id and text keep exactly one of them; an empty batch returns no rows and
appends nothing; very long texts cost their digest and nothing else; other columns of the batch are
not needed, and survivors keeps them whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import shared_path, staged

#: The ASCII white space that does not count: space and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def normal_text(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space, 32 bytes."""
    return F.unhex(F.sha2(normal_text(text).cast("binary"), 256))


def n_chars(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit("")))


class DigestIndex:
    """Digests seen so far, with the id of the row that stays for each.

    buckets is fixed when the index is made; size it so that one bucket fits a task (about 60
    bytes a distinct text). By default it is the session's number of shuffle partitions. An index
    with a name is a table of the warehouse and outlasts the session; one without lies in the scratch folder.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(self.table):
            spark.sql(
                f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS" + ("" if table else f" LOCATION '{shared_path(spark, 'digest-index')}'")
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def verdicts(self, prints: DataFrame) -> DataFrame:
        """Append what is new in prints (doc_id, digest, n_chars, row); a row per digest of prints.

        keep_id, keep_row and n_chars of the row that stays, batch in which the index got it,
        group_size, n_same: rows of prints that equal the best in length and id.
        """
        batch = uuid.uuid4().hex
        ids = prints.groupBy("digest", "n_chars", "doc_id").agg(F.count(F.lit(1)).alias("n_same"), F.min("row").alias("row"))
        best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("neg_id"), (-F.col("row")).alias("neg_row"), "n_same"))
        groups = staged(ids.groupBy("digest").agg(best.alias("best"), F.sum("n_same").alias("group_size")), "digest-groups")
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.select("digest", (-F.col("best.neg_id")).alias("keep_id"), (-F.col("best.neg_row")).alias("keep_row"), F.lit(batch).alias("batch"))
        fresh.repartition(self.buckets, "digest").write.mode("append").insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        found = groups.select("digest", "group_size", F.col("best.n_chars").alias("keep_chars"), F.col("best.n_same").alias("n_same")).join(self.rows().hint("merge"), "digest")
        return staged(found.withColumn("mine", F.col("batch") == batch).drop("batch"), "verdicts")

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Dedup docs against the index and within themselves, append what is new, return decisions.

        One row per row of docs: doc_id, keep_id, group_size (copies in this batch), kept,
        digest. Of copies within the batch the longest original text stays, then the smallest
        id; a text that the index had before keeps none of this batch.
        """
        text = docs[text_col]
        prints = staged(docs.select(docs[id_col].cast("long").alias("doc_id"), digest(text).alias("digest"), n_chars(text).alias("n_chars"), F.monotonically_increasing_id().alias("row")), "digests")
        kept = F.col("mine") & (F.col("row") == F.col("keep_row"))
        # both sides are plain shuffles of narrow rows: AQE splits the partition of a hot digest
        return prints.join(self.verdicts(prints), "digest").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")

    def survivors(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of docs that stay, with docs' own columns."""
        keyed = docs.select(docs[id_col].cast("long").alias("_id"), digest(docs[text_col]).alias("digest"), n_chars(docs[text_col]).alias("_n"), F.struct("*").alias("_doc"))
        prints = staged(keyed.select(F.col("_id").alias("doc_id"), "digest", F.col("_n").alias("n_chars"), F.lit(0).cast("long").alias("row")), "digests")
        best = keyed.join(self.verdicts(prints), "digest").filter("mine AND _id <=> keep_id AND _n = keep_chars")
        # rows that repeat id and text: one of them, by a grouping that only such rows enter
        once, repeats = best.filter("n_same = 1").select("_doc"), best.filter("n_same > 1").groupBy("digest").agg(F.first("_doc").alias("_doc"))
        return once.unionByName(repeats.select("_doc")).select("_doc.*")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """Decisions of docs against an index, a new empty one unless given."""
    return (index or DigestIndex(docs.sparkSession)).append(docs, id_col, text_col)
