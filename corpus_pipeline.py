"""The corpus pipeline: from raw documents to encoded training text, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
its result is written as Parquet and read again as the next one's docs. All but the last
return the columns of ``documents``. Empty tables pass through; nulls are handled as
the operators in ``strandline.llm`` say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, langid, mixing, neardup, quality
from strandline.llm._work import settled
from strandline.llm.queries import quality_weights, vocab_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the model knows, as learnt from all rows with a language."""
    return langid.keep_known(docs, langid.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that their evidence and their site's do not reject."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group (five-word shingles, similarity of 0.8 or more)."""
    return neardup.keep_one(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, samples drawn by the labels' quality weights."""
    return mixing.mixed_documents(docs, weights=quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    return bpe.encode(docs, vocab_path(), keep=("doc_id", "source"), exact_col="round_trip")


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources", mixed),
    ("BPE", encoded),
]

#: Models and sketches decide: SQL cannot express the stages. Tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settled(docs, f"stage{k}")
    return docs
