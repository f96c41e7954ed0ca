"""What a source string names: a file, a worksheet, a table or a stored profile."""

from __future__ import annotations

import re
from pathlib import Path, PurePosixPath
from urllib.parse import urlsplit, urlunsplit

from driftmark.errors import UnreadableSource

TEXT_FORMATS = (".csv", ".tsv", ".csv.gz", ".tsv.gz")
JSON_FORMATS = (".json", ".jsonl", ".ndjson")
PARQUET_FORMATS = (".parquet", ".pq")
ARROW_FORMATS = (".feather", ".arrow")
WORKBOOK_FORMATS = (".xlsx", ".xlsm")
FORMATS = (*TEXT_FORMATS, *JSON_FORMATS, *PARQUET_FORMATS, *ARROW_FORMATS, *WORKBOOK_FORMATS)
PROFILE_SUFFIX, VERSION_SUFFIX = ".profile.json", ".version"
#: Database schemes, and the JDBC subprotocol that each one is read by.
DATABASES = {"sqlite": "sqlite", "postgresql": "postgresql", "postgres": "postgresql", "mysql": "mysql", "mariadb": "mariadb"}
_UNSAFE = re.compile(r"[^\w.-]+")


def suffix_of(source: str) -> str | None:
    """The longest known extension of a name."""
    name = PurePosixPath(source.rstrip("/")).name.lower()
    return max((f for f in FORMATS if name.endswith(f)), key=len, default=None)


def is_profile(source: str) -> bool:
    return source.lower().endswith(PROFILE_SUFFIX)


def is_database(source: str) -> bool:
    scheme, mark, _ = source.partition("://")
    return bool(mark) and scheme.lower().partition("+")[0] in DATABASES


def split_table(source: str) -> tuple[str, str]:
    """(url, table) of ``url#table``."""
    url, mark, table = source.rpartition("#")
    if not mark or not table:
        raise UnreadableSource(f"{redacted(source)} names no table: write the connection URL, '#' and a table")
    return url, table


def is_workbook(source: str) -> bool:
    return suffix_of(source.partition("#")[0]) in WORKBOOK_FORMATS


def split_sheet(source: str) -> tuple[str, str | int | None]:
    """(path, sheet) of ``book.xlsx#name``, ``#2`` (position from 0) or ``#'2'`` (a name)."""
    path, mark, sheet = source.partition("#")
    if not mark or not sheet:
        return path, None
    if len(sheet) > 1 and sheet[0] == sheet[-1] and sheet[0] in "'\"":
        return path, sheet[1:-1]
    return path, int(sheet) if sheet.isdigit() else sheet


def redacted(source: str) -> str:
    """A source without its password, however malformed it is."""
    if not is_database(source):
        return source
    try:
        parts = urlsplit(source)
        if parts.password is None:
            return source if "@" not in parts.netloc or ":" not in parts.netloc.rpartition("@")[0] else _bluntly(source)
        host = parts.netloc.rpartition("@")[2]
        return urlunsplit(parts._replace(netloc=f"{parts.username}:***@{host}"))
    except ValueError:
        return _bluntly(source)


def _bluntly(source: str) -> str:
    scheme, mark, rest = source.partition("://")
    before, at, host = rest.rpartition("@")
    return f"{scheme}{mark}{before.partition(':')[0]}:***@{host}" if at else source


def described(source: str) -> str:
    return redacted(source)


def _plain(name: str) -> str:
    return _UNSAFE.sub("-", name).strip("-.") or "dataset"


def _table_name(source: str) -> str:
    try:
        return split_table(source)[1]
    except UnreadableSource:
        return "dataset"


def profile_path(source: str) -> Path:
    """Where a profile goes by default: beside the dataset, its format suffix replaced."""
    if is_database(source):
        return Path(_plain(_table_name(source)) + PROFILE_SUFFIX)
    book, sheet = split_sheet(source) if is_workbook(source) else (source, None)
    path, suffix = Path(book), suffix_of(book)
    stem = path.name[: -len(suffix)] if suffix and len(path.name) > len(suffix) else path.name
    return path.with_name(stem + (f"-{_plain(str(sheet))}" if sheet is not None else "") + PROFILE_SUFFIX)


def version_path(source: str) -> Path:
    """Where a version goes by default: beside the dataset, under its whole name."""
    if is_database(source):
        return Path(_plain(_table_name(source)) + VERSION_SUFFIX)
    book, sheet = split_sheet(source) if is_workbook(source) else (source, None)
    path = Path(book)
    return path.with_name(path.name + (f"-{_plain(str(sheet))}" if sheet is not None else "") + VERSION_SUFFIX)
