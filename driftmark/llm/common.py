"""Helpers shared by the corpus operators: tables, mapped columns, scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Text bytes that one call of a mapped function sees at most, unless one text is longer.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(query: Callable) -> Callable:
    """The query, with this package sent to the executors first where their path lacks it."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        root = str(Path(__file__).resolve().parents[2])
        context = spark.sparkContext
        there = [os.path.realpath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
        if root not in there and not getattr(context, "_driftmark_sent", False):
            archive = f"{tempfile.mkdtemp(prefix='driftmark-')}/driftmark.zip"
            with zipfile.ZipFile(archive, "w") as out:
                for path in sorted(Path(root, "driftmark").rglob("*.py")):
                    out.write(path, str(path.relative_to(root)))
            before = list(sys.path)
            context.addPyFile(archive)
            sys.path[:] = before  # the driver has the sources themselves
            context._driftmark_sent = True
        return query(spark, *args)

    return run


def quoted(name: str) -> F.Column:
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, which spark.checkpoint.dir names.

    Only a local master, whose executors are the driver, may do without: then a temporary
    folder is set for this session.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    context = spark.sparkContext
    if (held := context._jsc.sc().getCheckpointDir()).isDefined():
        return held.get()
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(made := tempfile.mkdtemp(prefix="driftmark-"))
    return made


#: Removes the shuffle files of a query that has ended; what it wrote stays.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_held: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release() -> None:
    """Deletes all scratch tables of this driver; results must have been read or written by then.
    Called when the driver's Python ends, and of use to sessions that go on for long."""
    for path, spark in list(_held.items()):
        with contextlib.suppress(Exception):  # the session may be gone with its files
            _delete(spark, path)
        _held.pop(path, None)


atexit.register(release)


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/driftmark-{uuid.uuid4().hex}"
        self.count = 0
        _held[self.root] = spark

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._scratch_path)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about limit bytes of text each."""
    sizes = [len(x) if x else 0 for x in _lengths(batch.column(column))]
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def _lengths(column: pa.Array) -> list[range]:
    import pyarrow.compute as pc

    return [range(x or 0) for x in pc.binary_length(column).to_pylist()]


def map_text(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[list[str]], dict[str, Sequence]]],
    fields: Sequence[tuple[str, T.DataType]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """The kept columns, then fields computed from each text (null: empty).

    make() runs once in each task and returns the function, which takes a list of texts.
    The kept columns travel under positional names, so that they may carry any name.
    """
    kept = [df.schema[name] for name in keep]
    source = df.select(*[quoted(n).alias(f"_k{i}") for i, n in enumerate(keep)], quoted(text).cast("string").alias("_text"))
    held = [T.StructField(f"_k{i}", f.dataType, True) for i, f in enumerate(kept)]
    schema = T.StructType(held + [T.StructField(f"_f{i}", kind, True) for i, (_, kind) in enumerate(fields)])
    names = [name for name, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, "_text"):
                got = apply([x or "" for x in part.column(len(held)).to_pylist()])
                columns = [part.column(i).cast(arrow.field(i).type) for i in range(len(held))]
                columns += [pa.array(got[n], arrow.field(len(held) + i).type) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = source.mapInArrow(run, schema)
    return out.select(*[F.col(f"_k{i}").alias(n) for i, n in enumerate(keep)], *[F.col(f"_f{i}").alias(n) for i, n in enumerate(names)])
