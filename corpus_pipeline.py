"""Corpus pipeline: documents in, token ids of what is worth training on out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last return the columns of docs.

Defined cases: null and empty texts pass through the stages like others (a null text stays
null until it is encoded as no tokens); very long texts are judged, scanned and encoded whole;
of repeated rows, and of near copies, near-dedup keeps one; rows without an id are decided by
their texts; an empty table gives empty stages; other columns may have any name and are kept.
Near-dedup links fingerprints of four-word shingles at 4 bits or fewer, as its operator does:
exact copies always meet, near copies as far as their fingerprints do (README has figures).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import bpe, compression_classifier, decontaminate, labelled, secrets, simhash
from driftmark.llm.common import Scratch, quoted, shipped, table

QUALITY_THRESHOLD = 0.3
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


@shipped
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the compression classifier scores below QUALITY_THRESHOLD."""
    examples = labelled.sample(docs, table(spark, sf_dir, "labels"), "quality", compression_classifier.PER_CLASS)
    score = _fresh(docs, "score")
    scored = compression_classifier.score_quality(docs, compression_classifier.train(examples), keep=docs.columns, name=score)
    return scored.filter(F.col(score) >= QUALITY_THRESHOLD).drop(score)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates one row: the least by id, nulls last, then by text.

    Groups are of fingerprints, so rows without an id, and unlike rows that share one, are
    each decided with the rows that they are like.
    """
    scratch = Scratch(spark)
    fp = _fresh(docs, "fp")
    row = F.struct("text", *[quoted(c) for c in docs.columns if c != "text"])
    printed = simhash.fingerprints(docs, keep=docs.columns, name=fp)
    printed = scratch.write(printed.select(F.col("doc_id").alias("key"), F.col(fp).alias("fp"), row.alias("row")))
    told = simhash.components(printed.select("key", "fp"), scratch)
    # fingerprints of a group that hold its least id: more than one where unlike rows share that id
    least = told.filter(F.col("first").eqNullSafe(F.col("component"))).select(F.col("fp").alias("kept"), "root", "component")

    def held(of: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.join(of, (F.col("fp") == F.col("kept")) & F.col("key").eqNullSafe(F.col("component")))

    # a group has more than one such row where ids are null or repeated
    tied = scratch.write(held(least, printed.select("key", "fp")).groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root"))
    if tied.limit(1).count():
        # the least row combines before the shuffle, so a large group does not meet in one task
        first = held(least.join(tied, "root", "left_semi"), printed).groupBy("root").agg(F.min("row").alias("row"))
        out = held(least.join(tied, "root", "left_anti"), printed).select("root", "row").unionByName(first)
    else:
        out = held(least, printed)
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])


@shipped
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs, however long they are."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@shipped
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; n_chars, where there is one, follows the text."""
    safe = _fresh(docs, "safe")
    out = secrets.redact_secrets(docs, keep=docs.columns, name=safe).withColumn("text", F.when(F.col("text").isNotNull(), F.col(safe))).drop(safe)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*map(quoted, docs.columns))


@shipped
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids, and the digests of a decoded round trip."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", byte_bpe),
]

#: No SQL: the classifier and the tokenizer have none; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return result
        before, docs = docs, scratch.write(result)
        if number:  # what the stage before wrote has been read
            scratch.drop(before)
    raise ValueError("there is no stage")
