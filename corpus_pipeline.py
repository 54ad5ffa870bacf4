"""The corpus pipeline: documents pass through five stages, each working on all that the one before kept.

Documents of low quality go; repeated lines are taken out of the rest; of each group of near duplicates (five
words a shingle, similarity of 0.8 or more) the least doc_id stays; documents that contain a benchmark item
go; what is left is encoded and decoded. Stages but the last return the columns of documents, whatever further
ones there are.

Nulls and edges: a null or empty text is scored like any other, has no lines to lose, is no near duplicate and
contains no item; a null text stays null until it is encoded, as an empty one. Rows without doc_id lose no lines
and are no duplicates. Of rows with one doc_id the near-duplicate stage keeps one. Of a group the least doc_id stays. Empty
tables give no rows; without labels nothing is rejected; without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termframe.llm import decontamination, line_dedup, minhash_dedup, quality, sentencepiece_codec
from termframe.llm.common import read, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject. As in its own query,
    a fifth of the labels is held out."""
    labels = read(spark, sf_dir, "labels").where(quality.fold(5) != 0)
    return quality.keep_good(docs, quality.train(docs, labels))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are repeated across documents; n_chars is that of the new text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.dedup_documents(docs, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_digests(docs)


STAGES = [
    ("quality classifier", good),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]
#: SQL can't express the classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
