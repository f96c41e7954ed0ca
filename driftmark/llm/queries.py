"""The corpus queries of the driver contract and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import sql
from driftmark.llm.common import shipped, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts look like the template, read back from its formatted text."""
    from driftmark.llm.chat_format import format_chats, masked_text, read_back

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    chats = format_chats(rows.unionByName(tricky))
    turns = read_back(F.col("formatted"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.withColumn("turns", turns).withColumn("learned", masked_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digests of the spans that the scan reports."""
    from driftmark.llm.secrets import BASE_KINDS, scan_secrets

    def joined(spans: str) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> F.Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 50-word windows that also start in a lesser document."""
    from driftmark.llm.debruijn import remove_passages

    return remove_passages(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: counts and digests of ids and decoded bytes."""
    import public_tokenizers

    from driftmark.llm.bpe import digest_round_trip

    return digest_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the component of its links."""
    from driftmark.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against those of its edited text and of the next document."""
    from driftmark.llm.fracsketch import compare_edits

    return compare_edits(table(spark, sf_dir, "documents"))


def _scored(scores: DataFrame, threshold: float) -> DataFrame:
    from driftmark.llm.labelled import held_out

    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by compression."""
    from driftmark.llm import compression_classifier as quality
    from driftmark.llm.labelled import sample

    docs = table(spark, sf_dir, "documents")
    model = quality.train(sample(docs, table(spark, sf_dir, "labels"), "quality", quality.PER_CLASS))
    return _scored(quality.score_quality(docs, model), 0.3)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that also start in a lesser document."""
    from driftmark.llm.suffix_levels import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that occur in windows of benchmark items."""
    from driftmark.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score by the factorization machine."""
    from driftmark.llm import factorization
    from driftmark.llm.labelled import sample

    docs = table(spark, sf_dir, "documents")
    model = factorization.train(sample(docs, table(spark, sf_dir, "labels"), "toxic", factorization.PER_CLASS))
    return _scored(factorization.score_toxicity(docs, model), 0.5)


QUERIES: dict[str, Query] = {
    "op1_chat_format": op1_chat_format,
    "op2_secret_scan": op2_secret_scan,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash": op5_simhash,
    "op6_fingerprint": op6_fingerprint,
    "op7_quality": op7_quality,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
}


def queries() -> dict[str, Query]:
    import corpus_pipeline

    return {name: shipped(query) for name, query in {**QUERIES, "pipeline": corpus_pipeline.run}.items()}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = dict(sql.ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
