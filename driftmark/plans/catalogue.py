"""Registered queries over the driver's tables, with their SQL oracles.

Each query runs the library's own operators; results of the size of the metadata come back
as a small DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import stats
from driftmark.functions.similarity import overlap
from driftmark.operators import profile as P
from driftmark.operators.compare import Comparison, compare, counts_up
from driftmark.operators.prepare import Prepared, prepare
from driftmark.operators.ranges import RANGE_VALUES, summaries
from driftmark.operators.rows import compare_rows, differs, joined, repeats
from driftmark.plans import rulejoin
from driftmark.plans.analyze import entry as changelog_entry
from driftmark.plans.analyze import report_on
from driftmark.plans.pairs import CHATS_NEW, CUSTOMER_NEW, ORDERS_NEW, chats_new, customer_new, orders_new, table
from driftmark.plans.rules import RuleSet, strongest
from driftmark.plans.versions import bump
from driftmark.sources import footer, text
from driftmark.types import FLOAT, TEXT, label_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Columns of the profile queries.
LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINEITEM_TEXT = ("l_returnflag", "l_linestatus")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def union(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def six(value: float | None) -> float | None:
    return None if value is None else round(value, 6)


def _names(found: Prepared) -> dict[str, str]:
    return {f.at: f.name for f in found.fields}


# --- profiles -------------------------------------------------------------------------


@query(union([f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_present FROM lineitem" for c in (*LINEITEM, *LINEITEM_TEXT)]))
def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prepare(table(spark, sf_dir, "lineitem").select(*LINEITEM, *LINEITEM_TEXT))
    rows, basic = P.moments(found)
    return spark.createDataFrame([(name, rows, basic[at]["n"]) for at, name in _names(found).items()], "column_name string, n_rows bigint, n_present bigint")


@query(f"WITH {ORDERS_NEW}\n" + union([f"SELECT '{c}' AS column_name, round(1 - count({c}) / count(*), 6) AS null_ratio FROM orders_new" for c in ("o_orderkey", "o_totalprice", "o_orderpriority", "o_channel")]))
def profile_null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prepare(orders_new(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_channel"))
    rows, basic = P.moments(found)
    return spark.createDataFrame([(name, round(1 - basic[at]["n"] / rows, 6)) for at, name in _names(found).items()], "column_name string, null_ratio double")


@query(union([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS cardinality FROM lineitem" for c in (*LINEITEM, *LINEITEM_TEXT, "l_shipdate")]))
def profile_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prepare(table(spark, sf_dir, "lineitem").select(*LINEITEM, *LINEITEM_TEXT, "l_shipdate"))
    counts = P.distinct_counts(found, found.fields)
    return spark.createDataFrame([(name, counts[at]) for at, name in _names(found).items()], "column_name string, cardinality bigint")


@query(union([f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean_value, round(stddev_pop({c}), 6) AS std_value, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM lineitem" for c in LINEITEM]))
def profile_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prepare(table(spark, sf_dir, "lineitem").select(*LINEITEM))
    _, basic = P.moments(found)
    rows = [(name, six(b["mean"]), six(b["std"]), b["min"], b["max"]) for at, name in _names(found).items() for b in [basic[at]]]
    return spark.createDataFrame(rows, "column_name string, mean_value double, std_value double, min_value double, max_value double")


def _levels(column: str, source: str, value: str) -> str:
    listed = ", ".join(map(str, stats.LEVELS))
    return f"SELECT '{column}' AS column_name, unnest([{listed}]) AS level, unnest(list_transform(quantile_cont({value}, [{listed}]), lambda q: round(CAST(q AS DOUBLE), 6))) AS quantile FROM {source}"


@query(union([_levels(c, "lineitem", f"CAST({c} AS DOUBLE)") for c in LINEITEM]))
def profile_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, prepare(table(spark, sf_dir, "lineitem").select(*LINEITEM)))


def _grids(spark: SparkSession, found: Prepared) -> DataFrame:
    grids = P.exact_numbers(found, found.fields, found.frame.count())
    rows = [(name, level, six(q)) for at, name in _names(found).items() for level, q in zip(stats.LEVELS, grids[at][0], strict=True)]
    return spark.createDataFrame(rows, "column_name string, level double, quantile double")


@query(_levels("l_extendedprice", "lineitem", "l_extendedprice"))
def profile_quantiles_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in many ranges, as for columns of very many values."""
    values = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("value"))
    grid, _ = summaries(values, 50 * RANGE_VALUES, stats.LEVELS)["value"]
    return spark.createDataFrame([("l_extendedprice", level, six(q)) for level, q in zip(stats.LEVELS, grid, strict=True)], "column_name string, level double, quantile double")


def _mode(c: str) -> str:
    return f"SELECT '{c}' AS column_name, {c} AS mode_value FROM (SELECT {c}, count(*) AS n FROM orders GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"


@query(union([f"({_mode(c)})" for c in ("o_orderstatus", "o_orderpriority")]))
def profile_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prepare(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))
    tops = P.top_values(found, {f.at: 1 for f in found.fields})
    return spark.createDataFrame([(name, tops[at][0][0]) for at, name in _names(found).items()], "column_name string, mode_value string")


@query(union([f"SELECT '{c}' AS column_name, {c} AS category, count(*) AS n FROM lineitem GROUP BY {c}" for c in LINEITEM_TEXT]))
def profile_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.profile(table(spark, sf_dir, "lineitem").select(*LINEITEM_TEXT))
    rows = [(c.name, value, n) for c in found.columns.values() for value, n in (c.counts or {}).items()]
    return spark.createDataFrame(rows, "column_name string, category string, n bigint")


@query("""
WITH counts AS (SELECT CAST(l_partkey % 997 AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1),
ranked AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS place FROM counts)
SELECT CASE WHEN place <= 200 THEN v ELSE '__other__' END AS category, CAST(sum(n) AS BIGINT) AS n FROM ranked GROUP BY 1
""")
def profile_category_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 997).cast("string").alias("v"))
    counts = P.profile(lines).columns["v"].counts or {}
    return spark.createDataFrame(list(counts.items()), "category string, n bigint")


@query(union(["SELECT DISTINCT 'o_orderpriority' AS column_name, o_orderpriority AS category FROM orders", "SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders"]))
def profile_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.profile(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))
    return spark.createDataFrame([(c.name, v) for c in found.columns.values() for v in c.categories or ()], "column_name string, category string")


@query(_levels("o_orderdate", "orders", "epoch(o_orderdate)"))
def profile_datetime_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grids(spark, prepare(table(spark, sf_dir, "orders").select("o_orderdate")))


@query("SELECT 'embedding' AS column_name, count(DISTINCT embedding) AS cardinality, count(embedding) AS n_present FROM embeddings")
def profile_array_text_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.profile(table(spark, sf_dir, "embeddings").select("embedding")).columns["embedding"]
    return spark.createDataFrame([(c.name, c.cardinality, c.present)], "column_name string, cardinality bigint, n_present bigint")


@query(union([f"SELECT '{c}' AS column_name, count(DISTINCT {c}) / count({c}) > 0.5 AS identifies FROM customer" for c in ("c_name", "c_mktsegment")]))
def profile_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.profile(table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"))
    return spark.createDataFrame([(c.name, c.counts is None) for c in found.columns.values()], "column_name string, identifies boolean")


@query("""
SELECT 'l_quantity' AS column_name, count(*) AS n_rows, round(1 - count(l_quantity) / count(*), 6) AS null_ratio, count(l_quantity) AS cardinality, CAST(min(l_quantity) AS DOUBLE) AS min_value, CAST(max(l_quantity) AS DOUBLE) AS max_value FROM lineitem
UNION ALL SELECT 'l_orderkey', count(*), round(1 - count(l_orderkey) / count(*), 6), count(l_orderkey), CAST(min(l_orderkey) AS DOUBLE), CAST(max(l_orderkey) AS DOUBLE) FROM lineitem
UNION ALL SELECT 'l_returnflag', count(*), round(1 - count(l_returnflag) / count(*), 6), count(l_returnflag), NULL, NULL FROM lineitem
""")
def footer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = footer.footer_profile(spark, f"{sf_dir}/lineitem.parquet")
    rows = [(c.name, c.rows, c.null_ratio, c.cardinality, c.minimum, c.maximum) for n in ("l_quantity", "l_orderkey", "l_returnflag") for c in [found.columns[n]]]
    return spark.createDataFrame(rows, "column_name string, n_rows bigint, null_ratio double, cardinality bigint, min_value double, max_value double")


@query()
def quantile_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.profile(table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity"), mode=P.SKETCH)
    rows = [(c.name, level, q) for c in found.columns.values() for level, q in zip(stats.LEVELS, c.quantiles or (), strict=True)]
    return spark.createDataFrame(rows, "column_name string, level double, quantile double")


@query()
def profile_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.as_frame(spark, P.profile(table(spark, sf_dir, "lineitem"), "lineitem"))


# --- types ----------------------------------------------------------------------------

_LABEL = "CASE WHEN column_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT') THEN 'int64' WHEN column_type IN ('FLOAT', 'DOUBLE') OR column_type LIKE 'DECIMAL%' THEN 'float64' WHEN column_type = 'BOOLEAN' THEN 'bool' WHEN column_type = 'DATE' OR column_type LIKE 'TIMESTAMP%' THEN 'datetime64' ELSE 'string' END"
TABLES = ("customer", "lineitem", "orders", "events", "embeddings", "part")


@query(union([f"SELECT '{t}' AS table_name, column_name, {_LABEL} AS label FROM (DESCRIBE SELECT * FROM {t})" for t in TABLES]))
def dtype_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, f.name, label_of(f.dataType)) for t in TABLES for f in table(spark, sf_dir, t).schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, label string")


@query("""
SELECT 'bool' AS label, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_true, count(*) FILTER (WHERE o_orderkey % 11 <> 0) AS n_present FROM orders WHERE o_orderkey % 11 <> 0
""")
def infer_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    word = F.when(key % 11 == 0, None).when(key % 3 == 0, " Yes").when(key % 2 == 0, "F").otherwise("no ")
    found = prepare(table(spark, sf_dir, "orders").select(word.alias("w")), infer=True)
    return found.frame.agg(F.lit(found.fields[0].label).alias("label"), F.count_if("c0").alias("n_true"), F.count("c0").alias("n_present"))


@query("""
SELECT 'whole' AS column_name, 'int64' AS label, round(sum(CAST(o_orderkey AS DOUBLE)), 6) AS total FROM orders
UNION ALL SELECT 'real', 'float64', round(sum(o_orderkey / 4.0), 6) FROM orders
UNION ALL SELECT 'mixed', 'string', NULL
""")
def infer_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit(" "), key.cast("string")).alias("whole"),
        F.format_string("%.2fe0", (key / 4).cast("double")).alias("real"),
        F.when(key % 100 == 1, "1d").otherwise(key.cast("string")).alias("mixed"),
    )
    found = prepare(rows, infer=True)
    parts = [found.frame.agg(F.round(F.sum(F.col(f.at).cast("double")), 6).alias("total")).select(F.lit(f.name).alias("column_name"), F.lit(f.label).alias("label"), "total") for f in found.fields if f.label != TEXT]
    texts = [(f.name, f.label, None) for f in found.fields if f.label == TEXT]
    out = spark.createDataFrame(texts, "column_name string, label string, total double")
    for part in parts:
        out = out.unionByName(part)
    return out


@query("""
SELECT 'iso' AS column_name, 'datetime64' AS label, CAST(sum(epoch(date_trunc('minute', o_orderdate))) AS DOUBLE) AS total, count(*) AS n_present FROM orders
UNION ALL SELECT 'slashed', 'datetime64', CAST(sum(epoch(date_trunc('day', o_orderdate))) FILTER (WHERE o_orderkey % 50 <> 0) AS DOUBLE), count(*) FILTER (WHERE o_orderkey % 50 <> 0) FROM orders
""")
def infer_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(
        F.date_format(day, "yyyy-MM-dd'T'HH:mm").alias("iso"),
        F.when(F.col("o_orderkey") % 50 == 0, "2024/13/45").otherwise(F.date_format(day, "M/d/yyyy")).alias("slashed"),
    )
    found = prepare(rows, infer=True)
    parts = [found.frame.agg(F.sum(P.as_double(f)).alias("total"), F.count(f.at).alias("n_present")).select(F.lit(f.name).alias("column_name"), F.lit(f.label).alias("label"), "total", "n_present") for f in found.fields]
    return parts[0].unionByName(parts[1])


@query('SELECT event_id, user_id AS "who.user.id", event_type AS "who.kind", value AS "amount.value" FROM events')
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").select(
        F.struct(F.struct(F.col("user_id").alias("id")).alias("user"), F.col("event_type").alias("kind")).alias("who"), "event_id", F.struct("value").alias("amount")
    )
    found = prepare(nested)
    return found.frame.toDF(*[f.name for f in found.fields])


# --- comparison -----------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> Comparison:
    return compare(P.profile(table(spark, sf_dir, "orders"), "orders"), P.profile(orders_new(spark, sf_dir), "orders_new"))


def _customers(spark: SparkSession, sf_dir: str) -> Comparison:
    return compare(P.profile(table(spark, sf_dir, "customer"), "customer"), P.profile(customer_new(spark, sf_dir), "customer_new"))


_ORDER_LABELS = f"""old AS (SELECT column_name, {_LABEL} AS label FROM (DESCRIBE SELECT * FROM orders)),
new AS (SELECT column_name, {_LABEL} AS label FROM (DESCRIBE SELECT * FROM orders_new))"""


@query(f"""WITH {ORDERS_NEW}, {_ORDER_LABELS}
SELECT coalesce(old.column_name, new.column_name) AS column_name, CASE WHEN new.column_name IS NULL THEN 'column_removed' ELSE 'column_added' END AS change
FROM old FULL JOIN new USING (column_name) WHERE (old.column_name IS NULL OR new.column_name IS NULL) AND coalesce(old.column_name, new.column_name) NOT IN ('o_orderstatus', 'order_status')
UNION ALL SELECT 'order_status', 'column_renamed'""")
def diff_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f.column, f.kind) for f in _orders(spark, sf_dir).findings if f.kind in ("column_added", "column_removed", "column_renamed")]
    return spark.createDataFrame(rows, "column_name string, change string")


@query(f"""WITH {ORDERS_NEW}, n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM orders_new) AS w)
SELECT CASE WHEN w > o THEN 'row_count_increased' ELSE 'row_count_decreased' END AS change, CAST(o AS DOUBLE) AS old_rows, CAST(w AS DOUBLE) AS new_rows, round(abs(w - o) / o * 100, 4) AS change_pct FROM n WHERE o <> w""")
def diff_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [f for f in _orders(spark, sf_dir).findings if f.kind.startswith("row_count")]
    return spark.createDataFrame([(f.kind, f.metrics["old_rows"], f.metrics["new_rows"], f.metrics["change_pct"]) for f in found], "change string, old_rows double, new_rows double, change_pct double")


@query(f"""WITH {ORDERS_NEW}, {_ORDER_LABELS}
SELECT column_name, old.label AS old_label, new.label AS new_label, CASE WHEN (old.label, new.label) IN (('bool', 'int64'), ('bool', 'float64'), ('int64', 'float64')) THEN 'type_changed_compatible' ELSE 'type_changed_incompatible' END AS change
FROM old JOIN new USING (column_name) WHERE old.label <> new.label""")
def diff_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f.column, f.details["dtype_old"], f.details["dtype_new"], f.kind) for f in _orders(spark, sf_dir).findings if f.kind.startswith("type_changed")]
    return spark.createDataFrame(rows, "column_name string, old_label string, new_label string, change string")


@query(f"""WITH {ORDERS_NEW}, r AS (SELECT (SELECT round(1 - count(o_orderpriority) / count(*), 6) FROM orders) AS o, (SELECT round(1 - count(o_orderpriority) / count(*), 6) FROM orders_new) AS w)
SELECT 'o_orderpriority' AS column_name, CASE WHEN w > o THEN 'nulls_introduced' ELSE 'nulls_fixed' END AS change, round(o * 100, 4) AS old_pct, round(w * 100, 4) AS new_pct, round(abs(w - o) * 100, 4) AS delta_pct FROM r WHERE abs(w - o) >= 0.01""")
def diff_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f.column, f.kind, *(f.metrics[m] for m in ("null_ratio_old", "null_ratio_new", "delta_pct"))) for f in _orders(spark, sf_dir).findings if f.kind.startswith("nulls_")]
    return spark.createDataFrame(rows, "column_name string, change string, old_pct double, new_pct double, delta_pct double")


@query(f"""WITH {CUSTOMER_NEW}, o AS (SELECT DISTINCT c_mktsegment AS v FROM customer), w AS (SELECT DISTINCT c_mktsegment AS v FROM customer_new)
SELECT 'c_mktsegment' AS column_name, 'new_category_added' AS change, v AS category FROM (SELECT v FROM w EXCEPT SELECT v FROM o)
UNION ALL SELECT 'c_mktsegment', 'category_removed', v FROM (SELECT v FROM o EXCEPT SELECT v FROM w)""")
def diff_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _customers(spark, sf_dir)
    rows = [(f.column, f.kind, v) for f in found.findings if f.kind in ("new_category_added", "category_removed") for v in f.details["categories"]]
    return spark.createDataFrame(rows, "column_name string, change string, category string")


def _psi(old: str, new: str) -> str:
    return f"""shares AS (
    SELECT greatest(coalesce(o.n, 0) / (SELECT sum(n) FROM {old}), 0.0001) AS o, greatest(coalesce(w.n, 0) / (SELECT sum(n) FROM {new}), 0.0001) AS w
    FROM {old} o FULL JOIN {new} w USING (v))
SELECT round(sum((w - o) * ln(w / o)), 6) AS psi FROM shares"""


@query(f"""WITH {CUSTOMER_NEW}, a AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer GROUP BY 1), b AS (SELECT c_mktsegment AS v, count(*) AS n FROM customer_new GROUP BY 1),
{_psi('a', 'b')}""")
def diff_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f.metrics["psi"],) for f in _customers(spark, sf_dir).of("category_balance_shift") if f.column == "c_mktsegment"]
    return spark.createDataFrame(rows, "psi double")


_TRUNCATED = """{name} AS (
    SELECT v, n, row_number() OVER (ORDER BY n DESC, v) <= 200 AS kept FROM (SELECT CAST({value} AS VARCHAR) AS v, count(*) AS n FROM lineitem WHERE {where} GROUP BY 1))"""


@query(
    "WITH "
    + _TRUNCATED.format(name="p", value="l_partkey % 331", where="l_partkey % 331 % 3 <> 1 OR l_linenumber = 1")
    + ", "
    + _TRUNCATED.format(name="q", value="l_partkey % 331", where="l_partkey % 331 % 2 <> 1 OR l_linenumber = 1")
    + """, common AS (SELECT v FROM p JOIN q USING (v) WHERE p.kept AND q.kept),
a AS (SELECT CASE WHEN v IN (SELECT v FROM common) THEN v ELSE '__other__' END AS v, sum(n) AS n FROM p GROUP BY 1),
b AS (SELECT CASE WHEN v IN (SELECT v FROM common) THEN v ELSE '__other__' END AS v, sum(n) AS n FROM q GROUP BY 1),
"""
    + _psi("a", "b")
)
def diff_psi_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories beyond those that a profile tracks are compared as one."""
    lines = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_partkey") % 331)
    sides = [P.profile(lines.filter((F.col("v") % m != 1) | (F.col("l_linenumber") == 1)).select(F.col("v").cast("string").alias("v"))).columns["v"] for m in (3, 2)]
    before, after = stats.comparable_counts(*[s.counts or {} for s in sides])
    return spark.createDataFrame([(stats.stability_index(before, after),)], "psi double")


def _ks(old: str, new: str) -> str:
    listed = ", ".join(map(str, stats.LEVELS))

    def grid(side: str, source: str) -> str:
        return f"SELECT '{side}' AS side, unnest(range(11)) AS i, unnest([{listed}]) AS level, unnest(quantile_cont(x, [{listed}])) AS v FROM ({source})"

    return f"""grids AS ({grid('o', old)} UNION ALL {grid('n', new)}),
segments AS (SELECT side, v, level, lead(v) OVER (PARTITION BY side ORDER BY i) AS v2, lead(level) OVER (PARTITION BY side ORDER BY i) AS level2 FROM grids),
ends AS (SELECT side, min(v) AS lo, max(v) AS hi FROM grids GROUP BY side),
points AS (SELECT DISTINCT v AS p FROM grids),
cdf AS (
    SELECT p, e.side, CASE WHEN p < lo THEN 0.0 WHEN p >= hi THEN 1.0 ELSE s.level + (p - s.v) / (s.v2 - s.v) * (s.level2 - s.level) END AS c
    FROM points CROSS JOIN ends e LEFT JOIN segments s ON s.side = e.side AND s.v <= p AND p < s.v2)
SELECT round(max(abs(a.c - b.c)), 6) AS ks FROM cdf a JOIN cdf b ON a.p = b.p AND a.side = 'o' AND b.side = 'n'"""


@query(f"WITH {ORDERS_NEW}, {_ks('SELECT o_totalprice AS x FROM orders', 'SELECT o_totalprice AS x FROM orders_new')}")
def diff_ks_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [f for f in _orders(spark, sf_dir).findings if f.column == "o_totalprice" and "ks_statistic" in f.metrics]
    return spark.createDataFrame([(f.metrics["ks_statistic"],) for f in found], "ks double")


@query(f"WITH {ORDERS_NEW}, {_ks('SELECT epoch(o_orderdate) AS x FROM orders', 'SELECT epoch(o_orderdate) AS x FROM orders_new')}")
def diff_ks_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [f for f in _orders(spark, sf_dir).findings if f.column == "o_orderdate" and "ks_statistic" in f.metrics]
    return spark.createDataFrame([(f.metrics["ks_statistic"],) for f in found], "ks double")


@query(f"""WITH {ORDERS_NEW}, m AS (SELECT (SELECT avg(o_totalprice) FROM orders) AS o, (SELECT avg(o_totalprice) FROM orders_new) AS w)
SELECT 'o_totalprice' AS column_name, round(o, 6) AS mean_old, round(w, 6) AS mean_new, round(abs(w - o) / abs(o) * 100, 4) AS mean_shift_pct FROM m""")
def diff_mean_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f.column, six(f.metrics["mean_old"]), six(f.metrics["mean_new"]), f.metrics["mean_shift_pct"]) for f in _orders(spark, sf_dir).findings if f.column == "o_totalprice"]
    return spark.createDataFrame(rows, "column_name string, mean_old double, mean_new double, mean_shift_pct double")


@query("""
WITH s AS (SELECT count(DISTINCT user_id) AS co, count(user_id) AS no, count(DISTINCT user_id) FILTER (WHERE user_id % 8 = 0) AS cn, count(*) FILTER (WHERE user_id % 8 = 0 OR event_id % 100 = 0) AS nn,
                  count(DISTINCT user_id) FILTER (WHERE user_id % 8 = 0 OR event_id % 100 = 0) AS cn2 FROM events)
SELECT CAST(no AS DOUBLE) AS cardinality_old, CAST(cn2 AS DOUBLE) AS cardinality_new, round(abs(cn2 - no) / no * 100, 4) AS change_pct FROM s
""")
def diff_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id column that comes to hold something that repeats."""
    events = table(spark, sf_dir, "events")
    old = events.select(F.col("event_id").alias("id"))
    new = events.filter((F.col("user_id") % 8 == 0) | (F.col("event_id") % 100 == 0)).select(F.col("user_id").alias("id"))
    found = compare(P.profile(old), P.profile(new)).of("cardinality_changed")
    return spark.createDataFrame([(f.metrics["cardinality_old"], f.metrics["cardinality_new"], f.metrics["change_pct"]) for f in found], "cardinality_old double, cardinality_new double, change_pct double")


@query("SELECT 'o_orderkey' AS column_name, count(*) = count(DISTINCT o_orderkey) AND count(DISTINCT o_orderkey) = max(o_orderkey) - min(o_orderkey) + 1 AS sequential FROM orders UNION ALL SELECT 'o_custkey', count(*) = count(DISTINCT o_custkey) AND count(DISTINCT o_custkey) = max(o_custkey) - min(o_custkey) + 1 FROM orders")
def diff_sequential_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.profile(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    return spark.createDataFrame([(c.name, counts_up(c)) for c in found.columns.values()], "column_name string, sequential boolean")


@query(f"""WITH {ORDERS_NEW}, {_ORDER_LABELS}
SELECT coalesce(new.column_name, old.column_name) AS column_name, CASE WHEN old.column_name IS NULL THEN 'added' WHEN new.column_name IS NULL THEN 'removed' WHEN coalesce(new.column_name, '') = 'o_orderkey' THEN 'unchanged' ELSE 'modified' END AS status, old.label AS old_label, new.label AS new_label
FROM old FULL JOIN new USING (column_name) WHERE coalesce(old.column_name, new.column_name) NOT IN ('o_orderstatus', 'order_status', 'o_orderkey')
UNION ALL SELECT 'order_status', 'renamed', 'string', 'string'""")
def column_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [s for s in _orders(spark, sf_dir).columns if s.name != "o_orderkey"]
    rows = [(s.name, s.status, s.old.label if s.old else None, s.new.label if s.new else None) for s in found]
    return spark.createDataFrame(rows, "column_name string, status string, old_label string, new_label string")


# --- rows -----------------------------------------------------------------------------


@query("SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS BIGINT) AS repeated FROM lineitem")
def rows_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prepare(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))
    return spark.createDataFrame([(repeats(found, ["l_orderkey", "l_linenumber"]),)], "repeated bigint")


def _order_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    return joined(prepare(table(spark, sf_dir, "orders")), prepare(orders_new(spark, sf_dir)), ["o_orderkey"])


@query(f"WITH {ORDERS_NEW} SELECT n.o_orderkey FROM orders_new n ANTI JOIN orders o USING (o_orderkey)")
def rows_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_rows(spark, sf_dir)[0].filter("in_old IS NULL").select(F.col("n_c0").alias("o_orderkey"))


@query(f"WITH {ORDERS_NEW} SELECT o.o_orderkey FROM orders o ANTI JOIN orders_new n USING (o_orderkey)")
def rows_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_rows(spark, sf_dir)[0].filter("in_new IS NULL").select(F.col("o_c0").alias("o_orderkey"))


@query(f"""WITH {ORDERS_NEW}, k AS (SELECT CAST(o.o_custkey AS VARCHAR) IS DISTINCT FROM n.o_custkey AS a, o.o_totalprice IS DISTINCT FROM n.o_totalprice AS b, o.o_orderdate IS DISTINCT FROM n.o_orderdate AS c, o.o_orderpriority IS DISTINCT FROM n.o_orderpriority AS d FROM orders o JOIN orders_new n USING (o_orderkey))
SELECT count(*) AS kept, count(*) FILTER (WHERE a OR b OR c OR d) AS modified, round(count(*) FILTER (WHERE a OR b OR c OR d) / count(*) * 100, 4) AS modified_pct FROM k""")
def rows_modified_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, pairs = _order_rows(spark, sf_dir)
    kept = both.filter("in_old AND in_new")
    changed = F.count_if(pairs[0][1] | pairs[1][1] | pairs[2][1] | pairs[3][1])
    return kept.agg(F.count("*").alias("kept"), changed.alias("modified")).withColumn("modified_pct", F.round(F.col("modified") / F.col("kept") * 100, 4))


@query(f"""WITH {ORDERS_NEW}, k AS (SELECT o.*, n.o_custkey AS nc, n.o_totalprice AS nt, n.o_orderdate AS nd, n.o_orderpriority AS np FROM orders o JOIN orders_new n USING (o_orderkey))
SELECT 'o_totalprice' AS column_name, count(*) FILTER (WHERE o_totalprice IS DISTINCT FROM nt) AS n_changed FROM k
UNION ALL SELECT 'o_orderdate', count(*) FILTER (WHERE o_orderdate IS DISTINCT FROM nd) FROM k
UNION ALL SELECT 'o_orderpriority', count(*) FILTER (WHERE o_orderpriority IS DISTINCT FROM np) FROM k
UNION ALL SELECT 'o_custkey', count(*) FILTER (WHERE CAST(o_custkey AS VARCHAR) IS DISTINCT FROM nc) FROM k""")
def rows_modified_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, pairs = _order_rows(spark, sf_dir)
    counts = both.filter("in_old AND in_new").agg(*[F.count_if(d).alias(name) for name, d in pairs])
    return counts.unpivot([], [name for name, _ in pairs], "column_name", "n_changed")


@query(f"""WITH {CHATS_NEW}, b AS (SELECT o.conv_id IS NULL AS come, n.conv_id IS NULL AS gone, o.text IS DISTINCT FROM n.text OR o.role IS DISTINCT FROM n.role AS differs
    FROM conversations o FULL JOIN chats_new n ON o.conv_id IS NOT DISTINCT FROM n.conv_id AND o.turn IS NOT DISTINCT FROM n.turn)
SELECT 'rows_replaced' AS change, round((count(*) FILTER (WHERE come) + count(*) FILTER (WHERE gone)) / count(*) FILTER (WHERE NOT gone) * 100, 4) AS share_pct FROM b
UNION ALL SELECT 'rows_modified', round(count(*) FILTER (WHERE NOT come AND NOT gone AND differs) / count(*) FILTER (WHERE NOT come AND NOT gone) * 100, 4) FROM b""")
def rows_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_rows(prepare(table(spark, sf_dir, "conversations")), prepare(chats_new(spark, sf_dir)), ["conv_id", "turn"])
    return spark.createDataFrame([(f.kind, f.metrics.get("replaced_pct", f.metrics.get("modified_pct"))) for f in found], "change string, share_pct double")


@query(f"""WITH {ORDERS_NEW}, b AS (SELECT o.o_orderkey IS NULL AS come, n.o_orderkey IS NULL AS gone FROM orders o FULL JOIN orders_new n USING (o_orderkey))
SELECT CAST(count(*) FILTER (WHERE come) AS DOUBLE) AS n_added, CAST(count(*) FILTER (WHERE gone) AS DOUBLE) AS n_removed, round((count(*) FILTER (WHERE come) + count(*) FILTER (WHERE gone)) / count(*) FILTER (WHERE NOT gone) * 100, 4) AS replaced_pct FROM b""")
def rows_replaced_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare_rows(prepare(table(spark, sf_dir, "orders")), prepare(orders_new(spark, sf_dir)), ["o_orderkey"])
    rows = [tuple(f.metrics[m] for m in ("rows_added", "rows_removed", "replaced_pct")) for f in found if f.kind == "rows_replaced"]
    return spark.createDataFrame(rows, "n_added double, n_removed double, replaced_pct double")


@query("""SELECT count(*) FILTER (WHERE CAST(CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE l_tax END AS DOUBLE) IS DISTINCT FROM CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_tax END) AS as_numbers,
count(*) FILTER (WHERE l_returnflag IS DISTINCT FROM CASE WHEN l_linenumber = 3 THEN lower(l_returnflag) ELSE l_returnflag END) AS as_text FROM lineitem""")
def rows_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    number = differs(F.when(line % 2 != 0, F.col("l_tax")), F.when(line % 4 != 0, F.col("l_tax")), FLOAT, FLOAT)
    words = differs(F.col("l_returnflag"), F.when(line == 3, F.lower("l_returnflag")).otherwise(F.col("l_returnflag")), TEXT, TEXT)
    return table(spark, sf_dir, "lineitem").agg(F.count_if(number).alias("as_numbers"), F.count_if(words).alias("as_text"))


# --- renames, rules, versions ---------------------------------------------------------


@query("""WITH a AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_size <= 25), b AS (SELECT DISTINCT p_brand AS v FROM part WHERE p_size % 3 = 0 AND p_retailprice > 1200)
SELECT round((SELECT count(*) FROM a JOIN b USING (v)) / (SELECT count(*) FROM (SELECT v FROM a UNION SELECT v FROM b)), 6) AS jaccard""")
def rename_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    sides = [P.profile(part.filter(f).select("p_brand")).columns["p_brand"] for f in ("p_size <= 25", "p_size % 3 = 0 AND p_retailprice > 1200")]
    values = [[r[0] for r in part.filter(f).select("p_brand").distinct().collect()] if s.categories is None else s.categories for s, f in zip(sides, ("p_size <= 25", "p_size % 3 = 0 AND p_retailprice > 1200"), strict=True)]
    return spark.createDataFrame([(six(overlap(*values)),)], "jaccard double")


@query("SELECT 'order_status' AS column_name, 'o_orderstatus' AS previous_name")
def rename_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(f.column, f.details["previous_name"]) for f in _orders(spark, sf_dir).of("column_renamed")]
    return spark.createDataFrame(rows, "column_name string, previous_name string")


#: Findings for the rule queries: kind, column, metric, value.
FINDINGS = (
    ("column_removed", "a", None, None),
    ("column_added", "b", "null_ratio", 0.5),
    ("row_count_decreased", None, "decrease_pct", 20.0),
    ("row_count_decreased", None, "decrease_pct", 20.0001),
    ("nulls_introduced", "c", "delta_pct", 10.5),
    ("nulls_introduced", "d", "delta_pct", 3.0),
    ("category_balance_shift", "e", "psi", 0.26),
    ("category_balance_shift", "f", "psi", 0.25),
    ("minor_stat_change", "g", "mean_shift_pct", 1.5),
    ("rows_modified", None, "modified_pct", 50.0),
)
_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in f) + ")" for f in FINDINGS)
STRICT = {"major": ["column_removed", {"rows_modified_greater_than": 25}], "patch": ["nulls_introduced", {"nulls_introduced": {"columns": ["z"]}}], "minor": [{"nulls_introduced": {"columns": ["d"]}}, {"row_count_decrease_greater_than": 20}]}
IGNORING = {"ignore": [{"column_removed": {"columns": ["a", "x"]}}, "rows_modified"], "major": ["column_removed", "rows_modified", "category_balance_shift"]}


def _rules_sql(rules: RuleSet) -> str:
    def text(v: object) -> str:
        return "NULL" if v is None else repr(v)

    rows = ", ".join(f"({i}, {text(s.word if s else None)}, {text(r.name)}, {text(r.kind)}, {text(r.metric)}, {text(r.threshold)}, {'NULL' if r.columns is None else sorted(r.columns)})" for i, (s, r) in enumerate(rules.ranked))
    return f"""WITH findings AS (SELECT row_number() OVER () AS id, * FROM (VALUES {_VALUES}) t(kind, column_name, metric, v)),
rules AS (SELECT * FROM (VALUES {rows}) r(place, severity, rule, kind, metric, threshold, scope)),
matched AS (SELECT f.id, f.kind, f.column_name, r.severity, r.rule, r.place FROM findings f LEFT JOIN rules r
    ON f.kind = r.kind AND (r.scope IS NULL OR list_contains(r.scope, f.column_name)) AND (r.threshold IS NULL OR (f.metric = r.metric AND f.v > r.threshold)))
SELECT kind, column_name, severity, rule FROM matched QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1"""


def _classified(spark: SparkSession, rules: RuleSet) -> DataFrame:
    rows = [(kind, column, {metric: value} if metric else {}) for kind, column, metric, value in FINDINGS]
    return rulejoin.classify(spark.createDataFrame(rows, "kind string, column_name string, metrics map<string, double>"), rules)


@query(_rules_sql(RuleSet.load()))
def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, RuleSet.load())


@query(_rules_sql(RuleSet.of(STRICT)))
def classify_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, RuleSet.of(STRICT))


@query(_rules_sql(RuleSet.of(IGNORING)))
def classify_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, RuleSet.of(IGNORING))


@query("""WITH n AS (SELECT count(*) AS o FROM orders), d AS (SELECT count(*) AS w FROM orders WHERE o_orderkey % 10 <> 0)
SELECT 'minor' AS bump, '1.5.0' AS next_version FROM n, d WHERE w < o AND (o - w) / o * 100 <= 20""")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the orders gone, nothing else: their keys, which count up, don't matter."""
    old = table(spark, sf_dir, "orders").select("o_orderstatus")
    new = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0").select("o_orderstatus")
    found = report_on(P.profile(old), P.profile(new), version="v1.4.2")
    return spark.createDataFrame([(found.bump.word if found.bump else None, found.next_version)], "bump string, next_version string")


@query("SELECT 'major' AS severity, '3.0.0' AS next_version UNION ALL SELECT 'minor', '2.5.0' UNION ALL SELECT 'patch', '2.4.8' UNION ALL SELECT 'none', '2.4.7'")
def suggested_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RuleSet.load()
    kinds = {"major": ["minor_stat_change", "column_removed"], "minor": ["nulls_fixed", "column_added"], "patch": ["nulls_fixed"], "none": []}
    from driftmark.operators.compare import Finding

    rows = [(name, bump("2.4.7", strongest(rules.evaluate([Finding(k, k) for k in found])))) for name, found in kinds.items()]
    return spark.createDataFrame(rows, "severity string, next_version string")


@query()
def detect_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = {"comma": ["a,b;c", "1,2;3"], "semicolon": ["a;b", '"x;y";2'], "tab": ["a\tb", "1\t2"], "pipe": ["a|b|c", "1|2|3"]}
    return spark.createDataFrame([(name, text.find_delimiter(lines)) for name, lines in samples.items()], "sample string, delimiter string")


@query()
def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _orders(spark, sf_dir)
    lines = changelog_entry(report_on(found.old, found.new, version="1.0.0")).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified findings between two versions of orders, rows matched on their key."""
    found = _orders(spark, sf_dir)
    extra = compare_rows(prepare(table(spark, sf_dir, "orders")), prepare(orders_new(spark, sf_dir)), ["o_orderkey"])
    report = report_on(found.old, found.new, version="1.0.0", extra=extra)
    rows = [(c.finding.kind, c.finding.column, c.severity.word if c.severity else None, c.rule, c.finding.text, dict(c.finding.metrics)) for c in report.classified]
    return spark.createDataFrame(rows, "kind string, column_name string, severity string, rule string, description string, metrics map<string, double>")


