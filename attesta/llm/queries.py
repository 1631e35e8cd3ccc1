"""The opN_ queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import oracles

QUERIES: dict = {}
ORACLES: dict[str, str] = oracles.ORACLES

#: Production weights of the sources: one hot web source and curated ones.
MIX_WEIGHTS = {"src0": 15, "src1": 6, "src2": 5, "src3": 4, "src4": 3, "src5": 2} | {f"src{i}": 1 for i in range(6, 20)}

#: Permitted sequence lengths, in tokens.
PACK_LENGTHS = (1024, 2048, 4096, 8192)


def vocabulary() -> str:
    """The rank file of the token counter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _register(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.mixing import OUT, mix

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, MIX_WEIGHTS).select("doc_id", *OUT)


@_register
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


@_register
def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.common import scratch_path
    from attesta.llm.resharding import reshard_files

    found = reshard_files(_table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "shards"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", "block")


@_register
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), PACK_LENGTHS)


@_register
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.quality_rules import quality_rules

    found = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed", "n_chars_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


@_register
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.language_id import identify, learn

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out)
    model = learn(labelled.select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


@_register
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.token_counts import token_counts

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary()).drop("text")


@_register
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


@_register
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.suffix_dedup import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


@_register
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from attesta.llm.kneser_ney import classify

    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    return classify(_table(spark, sf_dir, "documents"), trusted)
