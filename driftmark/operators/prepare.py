"""From any DataFrame to flat columns of the five labels.

Every column gets a positional name, so that dots, clashing cases and odd characters in
names never reach the planner; a Field remembers the real name and the label.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.types import BOOL, FLOAT, INT, MOMENT, TEXT, label_of

#: Columns of one aggregation, below the limits of generated code.
COLUMNS_PER_JOB = 100
#: Words that are true or false.
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "t", "y"), ("false", "no", "f", "n")
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|inf|infinity|Inf|Infinity|INF|INFINITY|nan|NaN)$"
DATE_LIKE = r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4})([T ][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?"
#: The least share of values that parse as moments.
PARSED_SHARE = 0.9


@dataclass(frozen=True)
class Field:
    name: str
    label: str
    at: str


@dataclass(frozen=True)
class Prepared:
    frame: DataFrame
    fields: tuple[Field, ...]

    def of(self, *labels: str) -> list[Field]:
        return [f for f in self.fields if f.label in labels]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def flat_columns(schema: T.StructType) -> list[tuple[str, Column, T.DataType]]:
    """(dotted name, column, type) of every leaf: plain columns first, then those of structs."""
    plain: list[tuple[str, Column, T.DataType]] = []
    nested: list[tuple[str, Column, T.DataType]] = []

    def walk(name: str, column: Column, kind: T.DataType, out: list) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{name}.{f.name}", column.getField(f.name), f.dataType, out)
        else:
            out.append((name, column, kind))

    for f in schema.fields:
        walk(f.name, F.col(quoted(f.name)), f.dataType, nested if isinstance(f.dataType, T.StructType) else plain)
    return plain + nested


def canonical(column: Column, kind: T.DataType) -> Column:
    """A column in the physical type of its label; NaN is missing."""
    label = label_of(kind)
    if label == FLOAT:
        value = column.cast("double")
        return F.when(~F.isnan(value), value)
    if label == INT:
        return column.cast("bigint")
    if label == MOMENT:
        return column.cast("timestamp")
    if isinstance(kind, T.ArrayType):
        return F.to_json(column)
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(column)))
    return column if label == BOOL else column.cast("string")


def prepare(df: DataFrame, infer: bool = False) -> Prepared:
    """Flat, labelled columns; with infer, text columns are read as what all their values are."""
    leaves = flat_columns(df.schema)
    frame = df.select(*[canonical(c, kind).alias(f"c{i}") for i, (_, c, kind) in enumerate(leaves)])
    fields = tuple(Field(name, label_of(kind), f"c{i}") for i, (name, _, kind) in enumerate(leaves))
    found = Prepared(frame, fields)
    return infer_types(found) if infer else found


def _trimmed(column: Column) -> Column:
    return F.trim(column)


def parsed_moment(column: Column) -> Column:
    """A moment from the usual spellings; month first, then day first; NULL if it is none."""
    text = F.regexp_replace(F.regexp_replace(F.trim(column), "/", "-"), "T", " ")
    formats = ("y-M-d[ H:m[:s[.SSSSSS]]]", "M-d-y[ H:m[:s]]", "d-M-y[ H:m[:s]]")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parsed_bool(column: Column) -> Column:
    word = F.lower(_trimmed(column))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def infer_types(found: Prepared) -> Prepared:
    """Text columns as bool, number or moment, if every value is one; else they stay text.

    One aggregation over all text columns tells, in as many jobs as COLUMNS_PER_JOB asks for.
    A column without values stays text. Values that look like moments but are none become
    missing, as long as PARSED_SHARE of them are moments.
    """
    texts = found.of(TEXT)
    told: dict[str, str] = {}
    for start in range(0, len(texts), COLUMNS_PER_JOB):
        checks = []
        for f in texts[start : start + COLUMNS_PER_JOB]:
            word = _trimmed(F.col(f.at))
            checks += [
                F.count(f.at).alias(f"{f.at}_n"),
                F.bool_and(F.lower(word).isin(*TRUE_WORDS, *FALSE_WORDS)).alias(f"{f.at}_b"),
                F.bool_and(F.when(word.isNotNull(), word.rlike(INTEGER) & word.try_cast("bigint").isNotNull())).alias(f"{f.at}_i"),
                F.bool_and(word.rlike(NUMBER)).alias(f"{f.at}_f"),
                F.bool_and(word.rlike(DATE_LIKE)).alias(f"{f.at}_d"),
                F.count(F.when(word.rlike(DATE_LIKE), parsed_moment(F.col(f.at)))).alias(f"{f.at}_p"),
            ]
        row = found.frame.agg(*checks).first()
        for f in texts[start : start + COLUMNS_PER_JOB]:
            n = row[f"{f.at}_n"]
            if not n:
                continue
            if row[f"{f.at}_b"]:
                told[f.at] = BOOL
            elif row[f"{f.at}_i"]:
                told[f.at] = INT
            elif row[f"{f.at}_f"]:
                told[f.at] = FLOAT
            elif row[f"{f.at}_d"] and row[f"{f.at}_p"] >= PARSED_SHARE * n:
                told[f.at] = MOMENT

    def read(f: Field) -> Column:
        column = F.col(f.at)
        label = told.get(f.at)
        if label == BOOL:
            column = parsed_bool(column)
        elif label == INT:
            column = _trimmed(column).cast("bigint")
        elif label == FLOAT:
            value = _trimmed(column).try_cast("double")
            column = F.when(~F.isnan(value), value)
        elif label == MOMENT:
            column = parsed_moment(column)
        return column.alias(f.at)

    frame = found.frame.select(*map(read, found.fields))
    return Prepared(frame, tuple(Field(f.name, told.get(f.at, f.label), f.at) for f in found.fields))


def epoch_seconds(column: Column) -> Column:
    return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)


def category_text(column: Column, label: str) -> Column:
    """A value as the category it is counted under."""
    return F.initcap(column.cast("string")) if label == BOOL else column.cast("string")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
