"""Documents to training tokens: quality, copies, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents. Null and empty
texts: the classifier gives them its bias's score, equal ones are copies, and they have no
near copies; null ids and categories are treated as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, exact_dedup, mixing, ngram_join, quality
from lodestone.llm.queries import tokenizer
from lodestone.llm.scratch import discard, scope, shared_path
from lodestone.session import table

#: A document is rejected if its score is below this.
QUALITY = 0.7
#: Share of the tokens that the mixture keeps.
RATE = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier takes for quality 1; learned from three folds of the labels."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.bucket_of(F.col("doc_id"), 4) != 2)
    out = quality.scored(docs, model)
    return out.filter(out[out.columns[-1]] >= QUALITY).drop(out.columns[-1])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.DigestIndex(spark).survivors(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard of 0.75."""
    return ngram_join.one_of_each(docs, t=0.75, n=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of RATE of the tokens at the target shares of sources, languages and topics; categories that have too little for theirs are taken whole."""
    return mixing.sample(docs, rate=RATE, way="filled")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return bpe.encoded(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mixing", mixed), ("bpe", tokens)]

#: Neither a trained classifier nor the encoder can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; of what the stages stage, only the last one's input stays."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        with scope(spark):
            left = stage(spark, docs, sf_dir)
            path = shared_path(spark, f"stage-{name}")
            left.write.parquet(path)
        before, docs = docs, spark.read.schema(left.schema).parquet(path)
        docs.staged_path = path
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
