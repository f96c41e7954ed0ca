"""JSON: an array or an object is read as a whole, JSON lines are split."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.errors import UnreadableSource

SAMPLED_LINES = 20


def spans_lines(lines: list[str]) -> bool:
    """Whether the document is one array, or one object over several lines. A reader told
    that of JSON lines would stop after the first of them without a word."""
    first = lines[0].lstrip("﻿ \t")
    if first.startswith("["):
        return True
    try:
        json.loads(first)
    except ValueError:
        return True
    return False


def other_records(spark: SparkSession, path: str, whole: bool) -> bool:
    """Whether some record, on whatever line or at whatever place of the array, is not an object."""
    if whole:
        text = F.trim(F.regexp_replace("value", "^\ufeff", ""))
        elements = F.from_json(text, "array<string>")
        odd = F.when(text.startswith("["), F.exists(elements, lambda x: x.isNull() | ~F.ltrim(x).startswith("{"))).otherwise(~F.ltrim(text).startswith("{"))
        return spark.read.text(path, wholetext=True).filter(odd).limit(1).count() > 0
    record = F.trim(F.translate("value", "\ufeff\t\r", "   "))
    return spark.read.text(path).filter((record != "") & ~record.startswith("{")).limit(1).count() > 0


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records as columns, objects as structs; a file without records has no columns."""
    lines = [r["value"] for r in spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(SAMPLED_LINES).collect()]
    if not lines or (len(lines) == 1 and lines[0].strip() in ("[]", "{}")):
        return spark.createDataFrame([], T.StructType([]))
    whole = spans_lines(lines)
    if other_records(spark, path, whole):
        raise UnreadableSource(f"{path} holds records that are not objects")
    try:
        df = spark.read.json(path, multiLine=whole, mode="FAILFAST")
        df.schema  # noqa: B018  a broken document fails here
    except Exception as error:
        raise UnreadableSource(f"{path} cannot be read as JSON: {str(error).splitlines()[0]}") from error
    return _first_seen_order(df, lines, whole)


def _first_seen_order(df: DataFrame, lines: list[str], whole: bool) -> DataFrame:
    """Spark sorts names; a dataset's own order is that of its first records."""
    seen: list[str] = []
    for line in [] if whole else lines:
        record = json.loads(line) if line.strip().endswith("}") else {}
        seen += [k for k in record if k not in seen]
    if whole:
        text = "\n".join(lines)
        try:
            start = text.index("{")
            record, _ = json.JSONDecoder().raw_decode(text[start:])
            seen = list(record)
        except ValueError:
            seen = []
    names = [n for n in seen if n in df.columns]
    return df.select(*[F.col(f"`{n}`") for n in names], *[F.col(f"`{n}`") for n in df.columns if n not in names])
