"""Documents to training sequences: quality rules, toxicity, near-duplicates, packing."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from argweave.llm import jaccard, packing, rules, toxicity  # noqa: E402
from argweave.llm.common import crc_mod, store, table, unused_prefix  # noqa: E402

#: Learned stages and byte-pair ids are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; the field is learned from the labels of the documents that arrive."""
    prefix = unused_prefix(docs)
    judged = rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")), prefix)
    return judged.where(F.col(f"{prefix}kept")).select(*docs.columns)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; learned from labels with crc32(doc_id) mod 5 other than 0."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    prefix = unused_prefix(docs)
    return toxicity.score(docs, model, prefix).where(F.col(f"{prefix}predicted") == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return jaccard.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its place in a sequence."""
    return packing.pack_documents(docs, packing.vocabulary_path())


STAGES = [("quality rules", quality_rules), ("toxicity", toxic_documents), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
