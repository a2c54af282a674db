"""The corpus pipeline: the stages in order, each working on all that its predecessor kept.

Quality rules drop what they reject, near-duplicate detection keeps one document of each group,
decontamination drops documents that hold a benchmark item, the secret scan masks secrets within
texts, and the last stage encodes each text into sampled pieces and checks that they decode.

Odd rows in every stage: a null text goes in the first stage, which finds no words in it, and
would pass the others as it is; null and repeated ids are judged by their texts, and of repeated
rows near-dedup keeps one; other columns pass through, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, near_dup, quality_rules, secret_scan, sentencepiece_sample
from graphloom.llm.common import read, saved
from graphloom.llm.queries import TOKENIZER_PIECES, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 80 % of five-word shingles in common."""
    return near_dup.keep_first(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secret_scan.mask_secrets(docs, secret_scan.fit(spark))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two segmentations of each document, sampled without replacement, as piece ids, and whether they decode to the text; the second in `more`."""
    # small batches, nothing kept: the executors still hold what the stages before have left
    return sentencepiece_sample.sample_segmentations(docs, vocabulary(TOKENIZER_PIECES), k=2, ids=True, digest=True, batch_chars=500_000, keep_vocabulary=False, one_row=True)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", encoding),
]

#: No SQL expresses the stages; tests/llm holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each stage's rows written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
