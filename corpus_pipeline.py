"""A corpus pipeline: quality rules, near-copy join, decontamination, source mixing and token output, each stage on what the last kept."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from forestflux.llm import decontam, jaccard, mixing, quality, tokens
from forestflux.llm.common import drop_table, release, scratch, shared_dir, table
from forestflux.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, Jaccard 0.8): that with the least doc_id."""
    return jaccard.keep_one(docs, n=5, per_cent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document (copies included), read back from the token files."""
    return tokens.encode_and_read(docs, tokenizer_path(), end=2)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]

#: The mix draws by hashes and the token files hold a tokenizer's ids, neither of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, each written as Parquet and read again; what a stage needs for itself goes with it.

    Defined cases: an empty table stays empty; null texts and ids and repeated rows are judged row by row by each stage as its operator
    states; columns beyond those of documents, whatever their names, pass through all stages but the last.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        path = shared_dir(spark, f"stage{number}")
        with nullcontext() if stage is token_output else scratch(spark):  # the token files are a product
            docs = table(stage(spark, docs, sf_dir), name, path=path)
        if before is not None:
            drop_table(before)
        before = docs
        release(spark)
    return docs
