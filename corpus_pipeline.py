"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import line_dedup, packing, quality, secrets, simhash
from feedloom.llm.common import release, stored, written
from feedloom.runtime import ship


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the quality classifier on the labelled documents and drop those that it rejects.

    All columns stay as they are. Whole texts are scored; null and empty ones get the model's prior; repeated rows score
    alike. Without labels the score is 0.5 and nothing is dropped. An empty table stays empty.
    """
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that ten sources or more share, all but their first occurrence; n_chars follows the text.

    No row goes, and no other column changes, whatever its name; null texts stay null, a null source is one source; repeated
    rows are one document; ties for the first occurrence go to the least doc_id, then text hash, then position.
    """
    return line_dedup.line_dedup(docs, counts=None)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least doc_id, of each group of near copies: five-word shingles, similarity 0.8.

    Kept rows stay as they are. Null text counts as empty, and empty texts are copies of each other; rows with a null
    doc_id stay; rows that repeat the one that stays, stay too. Whole texts are compared.
    """
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in whole texts by a mark; no row goes, and no other column changes. Null texts stay null; repeated rows
    are treated alike."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences: a row for each piece (see ``packing.pack``). Null and empty texts are their end
    id; other columns than doc_id and text are ignored; repeated rows are packed each."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", drop_low_quality),
    ("lines", drop_shared_lines),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and read again as the next one's input. A stage's own tables, and
    the result before, are deleted once its result is written; the last stage's stay until ``common.cleanup``."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), written(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
