"""Delimited text: the delimiter is found on a few lines, the rows are read by Spark."""

from __future__ import annotations

import csv
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.errors import UnreadableSource

DELIMITER_VARIABLE = "DRIFTMARK_CSV_DELIMITER"
CANDIDATES = (",", ";", "\t", "|")
SAMPLED_LINES = 20
#: Texts that mean a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def named_delimiter() -> str | None:
    """The delimiter that the environment asks for: one character, or a written tab."""
    value = os.environ.get(DELIMITER_VARIABLE, "")
    if not value:
        return None
    value = "\t" if value == "\\t" else value
    if len(value) != 1:
        raise UnreadableSource(f"{DELIMITER_VARIABLE} must be one character, got {value!r}")
    return value


def outside_quotes(line: str, character: str) -> int:
    """How often a character stands outside double quotes."""
    return sum(part.count(character) for part in line.split('"')[::2])


def find_delimiter(lines: Sequence[str], default: str = ",") -> str:
    """The candidate that every line has equally often, the most frequent one, the first of equals."""
    lines = [line for line in lines if line.strip()][:SAMPLED_LINES]
    if not lines:
        return default
    counts = {c: {outside_quotes(line, c) for line in lines} for c in CANDIDATES}
    steady = {c: n.pop() for c, n in counts.items() if len(n) == 1}
    best = max(steady, key=lambda c: steady[c], default=default)
    return best if steady.get(best) else default


def first_lines(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).limit(SAMPLED_LINES).collect()
    return [r["value"].rstrip("\r\n") for r in rows]


def unique_names(names: Sequence[str | None]) -> list[str]:
    """Names of a header: later ones of the same name get a number."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for i, name in enumerate(names):
        name = name or f"Unnamed: {i}"
        made, n = name, seen.get(name, 0)
        while made in seen:
            n += 1
            made = f"{name}.{n}"
        seen[name] = n
        seen.setdefault(made, 0)
        out.append(made)
    return out


def delimiter_of(path: str, lines: Sequence[str]) -> str:
    """What the environment names; a tab where the name says so; else what the first lines tell."""
    named = named_delimiter()
    if named is None:
        named = "\t" if path.lower().removesuffix(".gz").endswith(".tsv") else find_delimiter(lines)
    return named


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; missing values are NULL. Quoted line breaks make a file unsplittable,
    so they are only read as such where some line has an odd number of quotes: the first line of
    a record that goes on has. Short records end in missing values, and records with more
    values than the header are refused."""
    lines = first_lines(spark, path)
    if not lines:
        raise UnreadableSource(f"{path} is empty")
    delimiter = delimiter_of(path, lines)
    header = unique_names(next(csv.reader([lines[0].lstrip("\ufeff")], delimiter=delimiter)))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    multi = spark.read.text(path).filter(quotes % 2 == 1).limit(1).count() > 0
    raw = spark.read.csv(
        path, sep=delimiter, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi, enforceSchema=True,
        schema=", ".join(f"c{i} string" for i in range(len(header) + 1)), mode="PERMISSIVE",
    )
    if long := raw.filter(F.col(f"c{len(header)}").isNotNull()).select("c0").head():
        raise UnreadableSource(f"{path}: the record that begins with {long[0]!r} has more than the header's {len(header)} value(s)")
    present = [F.when(~F.col(f"c{i}").isin(*MISSING), F.col(f"c{i}")).alias(f"c{i}") for i in range(len(header))]
    return raw.select(*present).toDF(*header)
