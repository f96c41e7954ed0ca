"""The five canonical column labels, and what counts as a widening."""

from __future__ import annotations

from pyspark.sql import types as T

BOOL, INT, FLOAT, MOMENT, TEXT = "bool", "int64", "float64", "datetime64", "string"
LABELS = (BOOL, INT, FLOAT, MOMENT, TEXT)

#: Changes of type after which every old value still has its meaning.
WIDENINGS = frozenset({(BOOL, INT), (BOOL, FLOAT), (INT, FLOAT)})


def label_of(kind: T.DataType) -> str:
    """The label of a Spark type; declared types win over what the values look like."""
    if isinstance(kind, T.BooleanType):
        return BOOL
    if isinstance(kind, T.IntegralType):
        return INT
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return FLOAT
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return MOMENT
    return TEXT


def is_numeric(label: str) -> bool:
    return label in (INT, FLOAT)


def widens(old: str, new: str) -> bool:
    return (old, new) in WIDENINGS
