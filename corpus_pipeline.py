"""Corpus pipeline: quality classifier, SimHash near-dedup, decontamination, secret scan, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the
shared folder and rereads it as the next stage's documents. All stages but the last keep the columns of
documents; the last gives doc_id and the sampled piece ids of each kept text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import decontaminate, quality, secrets, sentencepieces, simhash
from tidegraph.llm.common import table
from tidegraph.llm.queries import tokenizer_file
from tidegraph.runtime import materialize

#: Near-duplicate stages on word shingles take five words and a similarity of 0.8.
SHINGLE = 5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, fitted on ``labels``; rows without an id are judged like any other."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts; equal rows and rows without an id take part."""
    return simhash.deduplicate(docs, SHINGLE, simhash.WIDE_RADIUS, simhash.BANDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``; a row without an id is judged by its own text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text and n_chars made to fit; null texts stay null."""
    return secrets.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless, ids) of each document; null and empty texts have no pieces."""
    return sentencepieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding", encode_pieces),
]

#: A trained model, fingerprint components and sampled segmentations are beyond SQL; tests hold run() against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
