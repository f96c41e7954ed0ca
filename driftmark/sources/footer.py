"""Profiles from Parquet footers: no row is decoded.

Spark answers counts and bounds from the footers through aggregate pushdown of its second
Parquet reader, in parallel over the files. Nested columns and columns without statistics
are refused as a whole, since a partial answer would look like an exact one.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.errors import FooterUnavailable
from driftmark.operators.profile import FOOTER, ColumnProfile, Profile
from driftmark.types import FLOAT, INT, label_of

_PUSHED = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}


def pushed(spark: SparkSession, path: str) -> tuple[DataFrame, T.StructType]:
    """The footer query, and the schema that it is about."""
    schema = spark.read.parquet(path).schema
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(schema.fields):
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            raise FooterUnavailable(f"{path}: column {f.name!r} is nested, which a footer does not describe")
        column = F.col("`" + f.name.replace("`", "``") + "`")
        if not isinstance(f.dataType, T.NullType):
            parts.append(F.count(column).alias(f"n{i}"))
        if label_of(f.dataType) in (INT, FLOAT) and not isinstance(f.dataType, T.DecimalType):
            parts += [F.min(column).alias(f"lo{i}"), F.max(column).alias(f"hi{i}")]
    return spark.read.parquet(path).agg(*parts), schema


def footer_profile(spark: SparkSession, path: str, source: str | None = None) -> Profile:
    """Types, missing values and numeric bounds. The cardinality is the number of present
    values, which never looks like a change of uniqueness."""
    own = spark.newSession()  # the caller's settings stay as they are
    for k, v in _PUSHED.items():
        own.conf.set(k, v)
    df, schema = pushed(own, path)
    try:
        row = df.first().asDict()
    except (PySparkException, Py4JJavaError) as error:  # Spark gives up where a column chunk has none
        raise FooterUnavailable(f"{path}: the footer has no statistics to answer from") from error
    rows = row["rows"]
    columns = {}
    for i, f in enumerate(schema.fields):
        n = row.get(f"n{i}", 0)
        bounds = {k: float(row[at]) if row.get(at) is not None else None for k, at in (("minimum", f"lo{i}"), ("maximum", f"hi{i}"))}
        if n and f"lo{i}" in row and row[f"lo{i}"] is None:
            raise FooterUnavailable(f"{path}: the footer has no bounds of column {f.name!r}")
        columns[f.name] = ColumnProfile(f.name, label_of(f.dataType), rows, round(1 - n / rows, 6) if rows else 0.0, n, **bounds)
    return Profile(source or path, rows, columns, FOOTER)
