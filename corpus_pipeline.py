"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data gets
pseudonyms, sources are mixed to target weights, texts are encoded.

Every stage works on all rows its predecessor kept, is written as Parquet to shared storage, and is
read again as the next one's documents. The last stage can't be expressed in SQL, and neither can
the first: tests/llm hold the whole against plain versions of the stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import bpe, mixing, near_dup, pseudonyms, toxicity
from matchloom.llm.common import Workspace, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject (op 5)."""
    lexicon, weights = toxicity.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text")
    return toxicity.accepted(docs, "text", lexicon, weights)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (op 6)."""
    return near_dup.survivors(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data (op 1)."""
    return pseudonyms.pseudonymise(docs, pseudonyms.key_of(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (op 2)."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document taken (op 9)."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_frame(docs.select("doc_id", "text"), "text", ranks, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done, made = work.names(), len(Workspace.made)
        docs = work.keep(stage(spark, docs, sf_dir), name)
        work.drop(*done)  # what the stage before wrote is read by nothing later
        Workspace.release(made)  # and neither is what this one wrote on the way
    return STAGES[-1][1](spark, docs, sf_dir)
