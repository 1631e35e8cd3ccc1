"""Corpus preparation: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm.common import cut
from attesta.llm.exact_dedup import drop_copies
from attesta.llm.jaccard_join import one_of_each
from attesta.llm.mixing import mixed_documents
from attesta.llm.packing import pack_texts
from attesta.llm.quality_rules import clean_documents
from attesta.llm.queries import MIX_WEIGHTS, PACK_LENGTHS, vocabulary
from attesta.llm.token_counts import token_pieces


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go from the texts, and documents that the rules reject go."""
    return clean_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order that interleaves the sources at their weights, with their place in it."""
    return mixed_documents(docs, MIX_WEIGHTS, keep=("mix_pos",))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces of the cleaned documents, with their text and their places in bins that follow the mixture window by window.

    Tokens are those of the token counter. The texts of a bin's pieces in the order of ``bin_offset`` make the sequence.
    """
    return pack_texts(token_pieces(docs.select("doc_id", "mix_pos", "text"), vocabulary(), max(PACK_LENGTHS)), PACK_LENGTHS)


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", packing),
]

#: The rules on lines, the schedule and the packing are not stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = cut(docs, f"stage-{at}")
    return docs
