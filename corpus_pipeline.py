"""From raw documents to packed training sequences, in five stages over the operators of ``thicket.llm``.

Each stage takes all rows that the one before it kept, as rows with the columns of ``documents``; the last returns the pieces
of packed sequences. Every stage's result is written as Parquet into the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicket.llm.exact_dedup import kept_documents as one_of_equals
from thicket.llm.near_dedup import near_dedup
from thicket.llm.packing import pack_documents
from thicket.llm.quality_rules import kept_documents as passing
from thicket.llm.queries import table, tokenizer_path
from thicket.llm.store import written
from thicket.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return one_of_equals(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("suffix-array dedup", repeats), ("packing", packing)]

#: Near-duplicate search, suffix arrays and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
