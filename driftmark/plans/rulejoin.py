"""Rules as a table: many findings classified by one join.

For a report, a rule set walks its rules; for tables of findings, such as the history of many
datasets, the rules become a small DataFrame and the first match a min_by over their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.plans.rules import RuleSet

RULES = "place int, severity string, rule string, kind string, metric string, threshold double, scope array<string>"


def rule_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    rows = [(i, s.word if s else None, r.name, r.kind, r.metric, r.threshold, sorted(r.columns) if r.columns else None) for i, (s, r) in enumerate(rules.ranked)]
    return spark.createDataFrame(rows, RULES)


def classify(findings: DataFrame, rules: RuleSet) -> DataFrame:
    """findings (kind, column_name, metrics: map<string, double>) with severity and rule.

    The rule table has as many rows as the rule file has entries, so it is broadcast.
    """
    table = F.broadcast(rule_table(findings.sparkSession, rules).withColumnRenamed("kind", "of"))
    value = F.try_element_at("metrics", F.col("metric"))
    match = (F.col("kind") == F.col("of")) & (F.col("scope").isNull() | F.coalesce(F.array_contains("scope", F.col("column_name")), F.lit(False))) & (F.col("threshold").isNull() | F.coalesce(value > F.col("threshold"), F.lit(False)))
    numbered = findings.withColumn("finding", F.monotonically_increasing_id())
    first = F.min_by(F.struct("severity", "rule"), "place").alias("first")
    keys = ["finding", "kind", "column_name"]
    return numbered.join(table, match, "left").groupBy(*keys).agg(first).select("kind", "column_name", F.col("first.severity").alias("severity"), F.col("first.rule").alias("rule"))
