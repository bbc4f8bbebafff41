"""The training-data pipeline: documents -> quality -> one of each near-duplicate group -> no benchmark items -> no secrets -> ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import chosen_path, pieces, quality_net, secrets, templates
from ledgerline.llm.common import prepare, stored, table
from ledgerline.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    prepare(spark)
    return quality_net.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the least doc_id."""
    prepare(spark)
    return chosen_path.keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return templates.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind."""
    prepare(spark)
    return secrets.redact(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with the digest of the text decoded from them."""
    prepare(spark)
    return pieces.piece_digests(docs, vocabulary("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_redaction),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]

#: The classifier and the coder are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each reading what the one before wrote."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
