"""A corpus from raw documents to token files, in five stages; counted as part of the subpackage llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as
Parquet to the shared folder and the next stage reads it from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import added_name, n_scratch, quoted, remove_scratch, stored
from tsengine.llm.decontaminate import cut_spans, find_contamination
from tsengine.llm.minhash import drop_near_duplicates
from tsengine.llm.mix import mix_sources, repeat_copies
from tsengine.llm.quality import THRESHOLD, score_quality, train_quality
from tsengine.llm.queries import tokenizer_path
from tsengine.llm.token_files import read_token_files, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    ranker = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = added_name(docs.columns, "score")
    return score_quality(docs, ranker, score_col=name).where(F.col(name) >= THRESHOLD).select(*quoted(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents without any stay as they are."""
    found = cut_spans(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    n_hit = quoted(found.columns)[-4]
    return found.withColumn("n_chars", F.when(n_hit > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*quoted(docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mix_sources(docs)
    return repeat_copies(mixed, docs.columns, mixed.columns[-2])


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files of the mix, and what stands in them for each document."""
    return read_token_files(spark, write_token_files(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_files", token_files)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = n_scratch()
        out = stage(spark, docs, sf_dir)
        inner = n_scratch()
        docs = stored(out, name)
        remove_scratch(before, inner)  # what only this stage needed
    return docs
