"""Sources by name: files, worksheets, database tables and stored profiles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from driftmark.errors import DatasetError, UnreadableSource, UnsupportedFormat
from driftmark.operators.prepare import Prepared, prepare
from driftmark.operators.profile import EXACT, FOOTER, Profile, profile, profile_prepared
from driftmark.sources import names
from driftmark.sources.documents import read_json
from driftmark.sources.footer import footer_profile
from driftmark.sources.stored import read_profile
from driftmark.sources.tables import read_arrow, read_table, read_workbook
from driftmark.sources.text import read_text


def reader_of(source: str):  # noqa: ANN201
    """(reader, whether its text columns are to be typed by their values)."""
    if names.is_database(source):
        return read_table, True
    if names.is_workbook(source):
        return read_workbook, True
    suffix = names.suffix_of(source)
    if suffix in names.TEXT_FORMATS:
        return read_text, True
    if suffix in names.JSON_FORMATS:
        return read_json, True
    if suffix in names.PARQUET_FORMATS:
        return lambda spark, path: spark.read.parquet(path), False
    if suffix in names.ARROW_FORMATS:
        return read_arrow, False
    raise UnsupportedFormat(f"{source}: unsupported format, expected one of {', '.join(names.FORMATS)}")


def load_frame(spark: SparkSession, source: str) -> DataFrame:
    """The rows of a source, as its reader gives them."""
    return _read(spark, source)[0]


def load_prepared(spark: SparkSession, source: str) -> Prepared:
    """Flat, labelled columns of a source."""
    df, infer = _read(spark, source)
    return prepare(df, infer)


def load_profile(spark: SparkSession, source: str | DataFrame, mode: str = EXACT) -> Profile:
    """A profile: stored, from the footer (Parquet in footer mode), or of the rows."""
    if not isinstance(source, str):
        return profile(source, mode=mode)
    if names.is_profile(source):
        return read_profile(source)
    if mode == FOOTER and names.suffix_of(source) in names.PARQUET_FORMATS:
        return footer_profile(spark, source, names.described(source))
    return profile_prepared(load_prepared(spark, source), names.described(source), EXACT if mode == FOOTER else mode)


def _read(spark: SparkSession, source: str) -> tuple[DataFrame, bool]:
    reader, infer = reader_of(source)
    try:
        return reader(spark, source), infer
    except (DatasetError, FileNotFoundError):
        raise
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"dataset not found: {source}") from error
        raise UnreadableSource(f"{names.described(source)} cannot be read: {str(error).splitlines()[0]}") from error
