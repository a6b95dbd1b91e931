"""Driver queries over the training-data operators, with production parameters, and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..runtime import ship
from . import bpe, exact_dedup, hnsw, line_dedup, packing, quality, secrets, sharding, simhash, warc


def _table(spark, sf_dir: str, name: str):
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark, sf_dir):
    captures = warc.captures(_table(spark, sf_dir, "pages"))
    return warc.digest(warc.resolve_revisits(captures.withColumn("payload", F.sha2("payload", 256))))


def op2_line_dedup(spark, sf_dir):
    rows = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op3_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op4_sharding(spark, sf_dir):
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op9_bpe(spark, sf_dir):
    return bpe.bpe_roundtrip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_hnsw(spark, sf_dir):
    return hnsw.embedding_groups(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_line_dedup, op3_quality, op4_sharding, op5_secrets, op6_packing, op7_exact_dedup, op8_simhash, op9_bpe, op10_hnsw)}

ORACLE_SQL = {
    "op1_warc_revisits": warc.ORACLE,
    "op2_line_dedup": line_dedup.oracle(),
    "op5_secrets": secrets.oracle(),
    "op7_exact_dedup": exact_dedup.ORACLE,
}
