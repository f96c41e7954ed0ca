"""Bounded samples of labelled documents, shared by the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) is 0 modulo this are never learnt from.
FOLDS = 5
#: Bytes of text that the rows of one class may have together.
CLASS_BYTES = 32 << 20


def held_out(key: F.Column) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id", text: str = "text", most_bytes: int = CLASS_BYTES) -> list[tuple[str, int]]:
    """Labelled texts of each class outside the held-out fold, whole and in a fixed order: at
    most per_class labels, whose texts have at most most_bytes together.

    The labels to learn from are those with the least hash of their key, so the sample does
    not depend on partitions. A key labelled twice counts with its lower label. A row whose
    text would exceed the bytes that are left is passed over; no text is cut. Null text is
    empty, keys without a document give nothing, and other columns are not read.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(label).cast("int").alias("label"))
        .withColumn("order", F.xxhash64("key"))
    )
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy("order", "key").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(picked), "key").withColumn("size", F.octet_length("text"))  # per_class bounds the keys
    # sizes first: what comes to the driver is bounded before it comes
    sizes = rows.groupBy("order", "key", "label").agg(F.sum("size").alias("size")).collect()
    left, taken = {0: most_bytes, 1: most_bytes}, []
    for row in sorted(sizes, key=lambda r: (r["order"], r["key"])):
        if row["size"] <= left[row["label"]]:
            left[row["label"]] -= row["size"]
            taken.append(row["key"])
    kind = rows.schema["key"].dataType
    chosen = docs.sparkSession.createDataFrame([(k,) for k in taken], f"key {kind.simpleString()}")
    found = rows.join(F.broadcast(chosen), "key", "left_semi").select("order", "key", "label", "text").collect()
    return [(r["text"], r["label"]) for r in sorted(found, key=lambda r: (r["order"], r["key"], r["text"]))]
