"""A training corpus from documents: toxic ones go, near-copies go, sources are mixed, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetsift.llm import mixing, pieces, simhash, toxicity
from fleetsift.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a machine, learned from the labelled ones, does not call toxic."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-copies."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids and whether they decode to the text."""
    return pieces.encoded(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_copies), ("mixing", mix_sources), ("sentencepiece", encode)]
#: The mix draws by a 64-bit hash and the encoder walks a vocabulary file: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
