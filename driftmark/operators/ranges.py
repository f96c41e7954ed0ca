"""Exact quantiles and distinct counts of number columns, together, in one shuffle.

Each task sorts its values in chunks and keeps (value, count) runs, cut at borders that a
sample gives and packed as bytes, so a value costs its own bytes in the shuffle and one that
half of the rows hold costs an entry a chunk. The runs of a column's range meet in one group,
whose size is bounded by the number of ranges, which follows the rows. The sizes of the ranges
tell which of them holds which rank; only counts and the values at the ranks asked for leave
the executors. The borders decide how even the ranges are, never the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a range is to hold, and rows that a task sorts at once.
RANGE_VALUES, CHUNK_ROWS = 2_000_000, 1_000_000
#: Ranges of a column at most, and sampled values for each.
MOST_RANGES, SAMPLED = 20_000, 20
#: Columns that go through one shuffle.
COLUMNS_PER_PASS = 8

_PACKED = "col int, part int, value binary, n binary"
_FOUND = "col int, part int, rank bigint, n bigint, value double"


def summaries(values: DataFrame, rows: int, levels: Sequence[float]) -> dict[str, tuple[tuple[float, ...], int]]:
    """By column: the values at the levels, linearly interpolated, and the distinct count.

    Columns are bigint or double without NaN; missing values do not count, and a column without
    any value is left out. rows is about how many there are, for the number of ranges only.
    """
    out: dict[str, tuple[tuple[float, ...], int]] = {}
    for start in range(0, len(values.columns), COLUMNS_PER_PASS):
        out |= _pass(values.select(*values.columns[start : start + COLUMNS_PER_PASS]), rows, levels)
    return out


def _borders(values: DataFrame, rows: int) -> list[list[float]]:
    """For each column the upper ends of all its ranges but the last, ascending."""
    parts = min(MOST_RANGES, rows // RANGE_VALUES + 1)
    if parts == 1:
        return [[] for _ in values.columns]
    sample = values.sample(min(1.0, parts * SAMPLED / rows), seed=1).toArrow()
    found = []
    for column in sample.columns:
        ordered = sorted(column.drop_null().to_pylist())
        found.append(sorted({ordered[i * len(ordered) // parts] for i in range(1, parts)}) if ordered else [])
    return found


def packed(values: DataFrame, borders: Sequence[Sequence[float]]) -> DataFrame:
    """The values as runs: column, range, ascending values, how often each occurs."""
    kinds = [{"bigint": "int64", "double": "float64"}[t] for _, t in values.dtypes]
    most = CHUNK_ROWS

    def pack(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        cuts = [np.array(b, k) for b, k in zip(borders, kinds, strict=True)]

        def runs(held):  # noqa: ANN001, ANN202
            rows = []
            for i, chunk in enumerate(held):
                value, n = np.unique(np.concatenate(chunk), return_counts=True)
                ends = [0, *np.searchsorted(value, cuts[i], side="right"), len(value)]
                rows += [(i, part, value[a:b].tobytes(), n[a:b].astype("int64").tobytes()) for part, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["col", "part", "value", "n"])

        held, size = [[] for _ in kinds], 0
        for batch in batches:
            for chunk, column in zip(held, batch.columns, strict=True):
                chunk.append(column.drop_null().to_numpy(zero_copy_only=False))
            size += batch.num_rows
            if size >= most:
                yield runs(held)
                held, size = [[] for _ in kinds], 0
        if size:
            yield runs(held)

    return values.mapInArrow(pack, _PACKED)


def _merged(runs: DataFrame, kinds: Sequence[str], asked: Mapping[tuple[int, int], Sequence[int]] | None = None) -> DataFrame:
    """Of each range its size and distinct count (ranks -1 and -2), or the values at ranks in it."""

    def merge(table):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        col, part = table["col"][0].as_py(), table["part"][0].as_py()
        value = np.concatenate([np.frombuffer(x.as_buffer(), kinds[col]) for x in table["value"]])
        n = np.concatenate([np.frombuffer(x.as_buffer(), "int64") for x in table["n"]])
        order = np.argsort(value, kind="stable")  # merges runs
        value, upto = value[order], np.cumsum(n[order])
        if asked is None:
            rows = [(-1, int(upto[-1]), 0.0), (-2, 1 + int((value[1:] != value[:-1]).sum()), 0.0)]
        else:
            rows = [(rank, 0, float(value[np.searchsorted(upto, rank, side="right")])) for rank in asked[col, part]]
        columns = [[col] * len(rows), [part] * len(rows), *zip(*rows, strict=True)]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["col", "part", "rank", "n", "value"])

    return runs.groupBy("col", "part").applyInArrow(merge, _FOUND)


def _pass(values: DataFrame, rows: int, levels: Sequence[float]) -> dict[str, tuple[tuple[float, ...], int]]:
    kinds = [{"bigint": "int64", "double": "float64"}[t] for _, t in values.dtypes]
    borders = _borders(values, rows)
    groups = sum(len(b) + 1 for b in borders)
    parts = max(groups, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = packed(values, borders).repartition(parts, "col", "part").persist()
    try:
        sizes: dict[int, dict[int, int]] = {}
        distinct: dict[int, int] = {}
        for r in _merged(runs, kinds).collect():
            if r["rank"] == -1:
                sizes.setdefault(r["col"], {})[r["part"]] = r["n"]
            else:
                distinct[r["col"]] = distinct.get(r["col"], 0) + r["n"]
        asked: dict[tuple[int, int], list[int]] = {}
        total = {col: sum(ranges.values()) for col, ranges in sizes.items()}
        before: dict[tuple[int, int], int] = {}
        for col, ranges in sizes.items():
            ranks = sorted({rank for level in levels for rank in _neighbours(level, total[col])})
            seen = 0
            for part in sorted(ranges):
                before[col, part] = seen
                if inside := [rank - seen for rank in ranks if seen <= rank < seen + ranges[part]]:
                    asked[col, part] = inside
                seen += ranges[part]
        at: dict[tuple[int, int], float] = {}
        if asked:
            wanted = F.struct("col", "part").isin([F.struct(F.lit(c).alias("col"), F.lit(p).alias("part")) for c, p in asked])
            for r in _merged(runs.filter(wanted), kinds, asked).collect():
                at[r["col"], before[r["col"], r["part"]] + r["rank"]] = r["value"]
    finally:
        runs.unpersist()
    out = {}
    for col, n in total.items():
        grid = []
        for level in levels:
            low, high = (at[col, rank] for rank in _neighbours(level, n))
            grid.append(low + (high - low) * (level * (n - 1) - int(level * (n - 1))))
        out[values.columns[col]] = (tuple(grid), distinct[col])
    return out


def _neighbours(level: float, n: int) -> tuple[int, int]:
    rank = int(level * (n - 1))
    return rank, min(rank + 1, n - 1)
