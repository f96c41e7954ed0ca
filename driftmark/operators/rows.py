"""Row comparison on a key: one full outer join and one aggregation.

Keys match null-safely, so null keys are equal. The join shuffles both sides on the key
(adaptive execution splits skewed partitions and broadcasts a small side); all counts come
from the one aggregation after it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.errors import BadKey
from driftmark.operators.compare import Finding
from driftmark.operators.prepare import COLUMNS_PER_JOB, Prepared, any_of, category_text
from driftmark.types import BOOL, is_numeric

#: Columns that a finding names at most.
NAMED = 10


def repeats(found: Prepared, key: Sequence[str]) -> int:
    """Rows that repeat a key already used; null keys are equal."""
    at = [next(f.at for f in found.fields if f.name == k) for k in key]
    groups = found.frame.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("r")).first()["r"]


def check_key(found: Prepared, key: Sequence[str], source: str) -> None:
    names = {f.name for f in found.fields}
    for k in key:
        if k not in names:
            raise BadKey(f"{source}: the key column {k!r} does not exist")
    if n := repeats(found, key):
        raise BadKey(f"{source}: ({', '.join(key)}) is not unique, {n} more row(s) than keys")


def differs(old: Column, new: Column, old_label: str, new_label: str) -> Column:
    """Numbers (and truth values) by value, anything else by text; missing equals missing."""
    if all(is_numeric(x) or x == BOOL for x in (old_label, new_label)):
        return ~old.cast("double").eqNullSafe(new.cast("double"))
    return ~category_text(old, old_label).eqNullSafe(category_text(new, new_label))


def joined(old: Prepared, new: Prepared, key: Sequence[str]) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """The full outer join with flags in_old, in_new, and a difference for each shared column."""
    before = {f.name: f for f in old.fields}
    after = {f.name: f for f in new.fields}
    left = old.frame.select(*[F.col(f.at).alias(f"o_{f.at}") for f in old.fields], F.lit(True).alias("in_old"))
    right = new.frame.select(*[F.col(f.at).alias(f"n_{f.at}") for f in new.fields], F.lit(True).alias("in_new"))
    match = None
    for k in key:
        o, n = F.col(f"o_{before[k].at}"), F.col(f"n_{after[k].at}")
        if before[k].label != after[k].label and not (is_numeric(before[k].label) and is_numeric(after[k].label)):
            o, n = category_text(o, before[k].label), category_text(n, after[k].label)
        part = o.eqNullSafe(n)
        match = part if match is None else match & part
    shared = [f.name for f in old.fields if f.name in after and f.name not in key]
    pairs = [(name, differs(F.col(f"o_{before[name].at}"), F.col(f"n_{after[name].at}"), before[name].label, after[name].label)) for name in shared]
    return left.join(right, match, "full_outer"), pairs


def compare_rows(old: Prepared, new: Prepared, key: Sequence[str], old_source: str = "old", new_source: str = "new") -> list[Finding]:
    """Rows added and removed, and rows whose values changed; at most two findings."""
    check_key(old, key, old_source)
    check_key(new, key, new_source)
    both, pairs = joined(old, new, key)
    kept = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    counts = [
        F.count_if(F.col("in_old").isNull()).alias("added"),
        F.count_if(F.col("in_new").isNull()).alias("removed"),
        F.count_if(kept).alias("kept"),
        F.count("in_new").alias("rows"),
        F.count_if(kept & any_of([d for _, d in pairs])).alias("modified"),
    ]
    row = both.agg(*counts, *[F.count_if(kept & d).alias(f"d{i}") for i, (_, d) in enumerate(pairs[:COLUMNS_PER_JOB])]).first()
    per_column = [(name, row[f"d{i}"]) for i, (name, _) in enumerate(pairs[:COLUMNS_PER_JOB])]
    for start in range(COLUMNS_PER_JOB, len(pairs), COLUMNS_PER_JOB):
        part = pairs[start : start + COLUMNS_PER_JOB]
        more = both.agg(*[F.count_if(kept & d).alias(f"d{i}") for i, (_, d) in enumerate(part)]).first()
        per_column += [(name, more[f"d{i}"]) for i, (name, _) in enumerate(part)]
    found = []
    if row["added"] or row["removed"]:
        moved = row["added"] + row["removed"]
        share = moved / row["rows"] * 100 if row["rows"] else moved  # a new version without rows: the bare count
        metrics = {"rows_added": float(row["added"]), "rows_removed": float(row["removed"]), "replaced_pct": round(float(share), 4)}
        found.append(Finding("rows_replaced", f"By key, {row['added']} row(s) are new and {row['removed']} are gone", metrics=metrics))
    if row["modified"]:
        share = row["modified"] / row["kept"] * 100
        ranked = sorted(((name, n) for name, n in per_column if n), key=lambda c: -c[1])[:NAMED]
        named = ", ".join(f"{name} ({n})" for name, n in ranked)
        text = f"By key, {share:.1f}% of the kept rows differ ({row['modified']} of {row['kept']}), in {named}"
        found.append(Finding("rows_modified", text, metrics={"rows_modified": float(row["modified"]), "modified_pct": round(share, 4)}, details={"columns": dict(ranked)}))
    return found
