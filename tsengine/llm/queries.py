"""The queries of this subpackage, one for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import bpe_digest
from .centroids import cluster_vectors
from .chat import fit_roles, format_chats
from .common import shared_folder
from .decontaminate import contamination_digest, find_contamination
from .embed_dedup import similar_vectors
from .minhash import near_duplicates
from .mix import mix_sources
from .oracle import CENTROIDS, DECONTAMINATE, EMBEDDINGS, MIX, REPEATS, SECRETS, SPELLING
from .quality import THRESHOLD, held_out, score_quality, train_quality
from .secrets import find_secrets, secrets_digest
from .spelling import spelling_variants
from .suffix_dedup import remove_repeats, repeats_digest
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _read(spark, sf_dir, "conversations")
    return format_chats(talks, fit_roles(talks))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(find_contamination(docs, _read(spark, sf_dir, "benchmark")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-files")
    return read_token_files(spark, write_token_files(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), folder))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(find_secrets(_read(spark, sf_dir, "documents")))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of operator 5 that SQL can express: its spans without those of the learned formats."""
    found = find_secrets(_read(spark, sf_dir, "documents")).withColumn("spans", F.filter("spans", lambda x: x["kind"] != "format"))
    return secrets_digest(found).withColumnRenamed("spans", "base_spans")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(remove_repeats(_read(spark, sf_dir, "documents")))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, train_quality(docs, _read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(_read(spark, sf_dir, "embeddings"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digest(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_read(spark, sf_dir, "embeddings")).drop("scanned")


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_mix_sources, op3_decontaminate, op4_token_files, op5_secret_scan, op6_suffix_dedup, op7_minhash_dedup, op8_token_counts, op9_quality, op10_embedding_dedup, op11_byte_bpe, op12_spelling, op13_centroids, secret_base_spans)}
ORACLE_SQL = {"op2_mix_sources": MIX, "op3_decontaminate": DECONTAMINATE, "op6_suffix_dedup": REPEATS, "op10_embedding_dedup": EMBEDDINGS, "op12_spelling": SPELLING, "op13_centroids": CENTROIDS, "secret_base_spans": SECRETS}
