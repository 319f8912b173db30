"""From raw documents to token ids: five stages, each an operator of scanweave.llm.

Every stage reads what its predecessor wrote.  The first four return the columns of documents:
toxic documents go, then those that the quality rules reject, then all but one of each group of
near duplicates, then those that hold benchmark windows.  The last one encodes what is left.
"""

from pyspark.sql import DataFrame, SparkSession

from scanweave.llm import bpe, decontaminate, ngram_join, outliers, toxicity
from scanweave.llm.shared import settle, table
from scanweave.llm.vocabularies import WORD_BPE, vocabulary_file
from scanweave.shipping import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    ship(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    ship(spark)
    return outliers.without_outliers(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    ship(spark)
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    ship(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of ids and decoded text."""
    ship(spark)
    raw = vocabulary_file(WORD_BPE)
    return bpe.digests(bpe.encode(docs, raw, bpe.lexicon_of(docs, raw), decoded=True), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_outliers),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: a learned lexicon, an iterated estimate and a tokenizer are beyond SQL; tests/llm/test_pipeline.py checks the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
