"""Deterministic second versions of the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after a change: rows gone and come, a column renamed, retyped and added, nulls, shifts."""
    old = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    changed = old.select(
        key,
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.col("o_orderstatus").alias("order_status"),
        F.when(key % 3 == 0, F.col("o_totalprice") * 1.75).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        (F.col("o_orderdate") + F.expr("INTERVAL '400' DAY")).alias("o_orderdate"),
        F.when(key % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(key % 3 == 0, "web").when(key % 3 == 1, "shop").otherwise("phone").alias("o_channel"),
    )
    return changed.filter(key % 20 != 0).unionByName(changed.filter(key % 50 == 1).withColumn("o_orderkey", key + 10_000_000))


ORDERS_NEW = """orders_changed AS (
    SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus AS order_status,
           CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 1.75 ELSE o_totalprice END AS o_totalprice,
           o_orderdate + INTERVAL '400' DAY AS o_orderdate,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS o_orderpriority,
           CASE o_orderkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'shop' ELSE 'phone' END AS o_channel
    FROM orders
), orders_new AS (
    SELECT * FROM orders_changed WHERE o_orderkey % 20 <> 0
    UNION ALL
    SELECT * REPLACE (o_orderkey + 10000000 AS o_orderkey) FROM orders_changed WHERE o_orderkey % 50 = 1
)"""


def customer_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose segments have moved: one is gone, one has doubled, one is new."""
    old = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "MACHINERY").when(key % 11 == 0, "SPACE").otherwise(F.col("c_mktsegment"))
    return old.withColumn("c_mktsegment", segment).withColumn("c_acctbal", F.when(key % 5 == 0, F.col("c_acctbal") + 25.0).otherwise(F.col("c_acctbal")))


CUSTOMER_NEW = """customer_new AS (
    SELECT * REPLACE (
        CASE WHEN c_mktsegment = 'BUILDING' THEN 'MACHINERY' WHEN c_custkey % 11 = 0 THEN 'SPACE' ELSE c_mktsegment END AS c_mktsegment,
        CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 25.0 ELSE c_acctbal END AS c_acctbal)
    FROM customer
)"""


def chats_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with some turns gone and some rewritten; the key is composite."""
    old = table(spark, sf_dir, "conversations")
    text = F.when((F.col("conv_id") + F.col("turn")) % 9 == 0, F.upper("text")).otherwise(F.col("text"))
    return old.withColumn("text", text).filter((F.col("conv_id") * 3 + F.col("turn")) % 13 != 0)


CHATS_NEW = """chats_new AS (
    SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 9 = 0 THEN upper(text) ELSE text END AS text
    FROM conversations WHERE (conv_id * 3 + turn) % 13 <> 0
)"""
