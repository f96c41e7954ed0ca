"""Arrow files, worksheets and database tables."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from driftmark.errors import UnreadableSource
from driftmark.sources.names import DATABASES, redacted, split_sheet, split_table


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (feather), each decoded by the executor that gets its bytes, of which
    there may be 2 GB in a file. Only the schema of the first one comes to the driver."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path).select("content")

    def opened(content: bytes):  # noqa: ANN202
        try:
            return pa.ipc.open_file(pa.BufferReader(content))
        except pa.ArrowInvalid:
            return pa.ipc.open_stream(pa.BufferReader(content))

    def heads(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for content in batch.column(0):
                try:
                    row = [opened(content.as_py()).schema.serialize().to_pybytes()], [None]
                except Exception as error:  # noqa: BLE001  told by the driver
                    row = [None], [str(error)]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.binary()), pa.array(row[1], pa.string())], names=["schema", "error"])

    head = files.limit(1).mapInArrow(heads, "schema binary, error string").first()
    if head is None:
        raise UnreadableSource(f"{path} holds no Arrow file")
    if head["schema"] is None:
        raise UnreadableSource(f"{path} is not a readable Arrow file: {head['error']}")
    schema = from_arrow_schema(pa.ipc.read_schema(pa.py_buffer(bytes(head["schema"]))), prefer_timestamp_ntz=True)

    def decode(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for content in batch.column(0):
                yield from opened(content.as_py()).read_all().to_batches(max_chunksize=10_000)

    return files.mapInArrow(decode, schema)


def read_workbook(spark: SparkSession, source: str) -> DataFrame:
    """One worksheet, the first by default; needs the optional openpyxl."""
    import pandas as pd

    path, sheet = split_sheet(source)
    try:
        frame = pd.read_excel(path, sheet_name=0 if sheet is None else sheet)
    except ImportError as error:
        raise UnreadableSource("reading a workbook needs openpyxl: pip install openpyxl") from error
    except (ValueError, IndexError) as error:
        raise UnreadableSource(f"{source}: {error}; sheets: {', '.join(pd.ExcelFile(path).sheet_names)}") from error
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None).astype("string"))


def read_table(spark: SparkSession, source: str, partitions: int | None = None, column: str | None = None, bounds: tuple[int, int] | None = None) -> DataFrame:
    """A whole table over JDBC, in parallel ranges of a numeric column where one is given.

    Without the driver's jar, SQLite files are read by the Python standard library instead.
    """
    url, table = split_table(source)
    scheme = url.partition("://")[0].lower().partition("+")[0]
    parts = urlsplit(url)
    if DATABASES[scheme] == "sqlite":
        return _sqlite(spark, unquote(url.partition("://")[2])[1:] or "", table, source)
    host = f"{parts.hostname}{f':{parts.port}' if parts.port else ''}"
    options = {"url": f"jdbc:{DATABASES[scheme]}://{host}{parts.path}", "dbtable": table}
    options |= {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v}
    if column and partitions and bounds:
        options |= {"partitionColumn": column, "numPartitions": str(partitions), "lowerBound": str(bounds[0]), "upperBound": str(bounds[1])}
    try:
        return spark.read.format("jdbc").options(**options).load()
    except Exception as error:
        reason = str(error).splitlines()[0]
        if parts.password:
            reason = reason.replace(unquote(parts.password), "***")
        raise UnreadableSource(f"{redacted(source)} cannot be read: {reason}") from error


#: Row numbers of a SQLite table that one task reads.
SQLITE_ROWS = 500_000


def _sqlite(spark: SparkSession, path: str, table: str, source: str) -> DataFrame:
    """A table's columns as text, read by the executors in ranges of its row numbers; what has
    none (a view) is read by one. The file has to be where the executors can open it."""
    import sqlite3
    from pathlib import Path

    import pyarrow as pa
    from pyspark.sql import types as T

    if not Path(path).is_file():
        raise FileNotFoundError(f"{source}: no such database file")
    name = '"' + table.replace('"', '""') + '"'
    at = f"{Path(path).absolute().as_uri()}?mode=ro"
    with sqlite3.connect(at, uri=True) as connection:
        try:
            names = [d[0] for d in connection.execute(f"SELECT * FROM {name} LIMIT 0").description]  # noqa: S608  a quoted identifier
        except sqlite3.Error as error:
            raise UnreadableSource(f"{source} cannot be read: {error}") from error
        try:
            low, high = connection.execute(f"SELECT min(rowid), max(rowid) FROM {name}").fetchone()  # noqa: S608
        except sqlite3.Error:
            low = high = None
    ranges = [(None, None)] if low is None else [(i, min(high, i + SQLITE_ROWS - 1)) for i in range(low, high + 1, SQLITE_ROWS)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def read(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for first, last in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                limits, where = ((), "") if first is None else ((first, last), " WHERE rowid BETWEEN ? AND ?")
                with sqlite3.connect(at, uri=True) as connection:
                    cursor = connection.execute(f"SELECT * FROM {name}{where}", limits)  # noqa: S608
                    while rows := cursor.fetchmany(10_000):
                        columns = [pa.array([None if v is None else str(v) for v in c], pa.string()) for c in zip(*rows, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return spark.createDataFrame(ranges, "first bigint, last bigint").repartition(len(ranges)).mapInArrow(read, schema)
