"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch holds every distinct shingle hash below 2**64 / scale. The scale is one fixed number,
SCALE, for all texts, so sketches merge by union and containment can be estimated between
very unequal documents; sketches of different scales compare after dropping what lies above
the lower threshold. A text of which no hash is that low keeps its least one, so that short
texts that differ have different sketches.

Shingles are SHINGLE consecutive UTF-8 bytes, about three words of prose; a shorter,
non-empty text is one shingle. Texts are hashed in portions, of which only what is kept is
held on to. A fingerprint is written ``scale:`` and the base64 of the ascending hashes, five
bytes each, of which the highest bits tell the threshold.

Likeness is the shared part of the smaller sketch at the common scale: 1 for equal
fingerprints, 0 if one of two different sketches is empty there.

Defined cases: null text is empty; its fingerprint, without hashes, is like no other but
itself; a very long text is one of many portions; the next document is the one that follows
by (doc_id, text), nulls first, so ties and repeated rows are each a document; the only
document follows itself; an empty table gives no rows; other columns may have any name and
are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import map_text, quoted
from driftmark.llm.rolling import windows

SHINGLE = 16
#: A sketch keeps the hashes in the lowest one of so many parts of their range.
SCALE = 8
#: Bits of a hash that a fingerprint keeps.
HASH_BITS = 40
#: Bytes that are hashed at a time.
PORTION = 1 << 18


def sketch(text: str | bytes, scale: int = SCALE) -> tuple[int, np.ndarray]:
    """(scale, ascending distinct HASH_BITS-bit hashes below the threshold, the least one at any rate)."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    if not data:
        return scale, np.empty(0, np.uint64)
    units = np.frombuffer(data, np.uint8)
    size = min(SHINGLE, len(units))
    kept = np.empty(0, np.uint64)
    for start in range(0, len(units) - size + 1, PORTION):
        part = units[start : start + PORTION + size - 1]
        hashes = windows(part, size, seed=len(units) if len(units) < SHINGLE else 0) >> np.uint64(64 - HASH_BITS)
        kept = np.concatenate([kept, lowest(hashes, scale)])
    return scale, lowest(np.unique(kept), scale)


def lowest(hashes: np.ndarray, scale: int) -> np.ndarray:
    """Those below the threshold; if there are none, the least."""
    kept = hashes[hashes < np.uint64((1 << HASH_BITS) // scale)]
    return kept if len(kept) or not len(hashes) else hashes.min(keepdims=True)


def at_scale(one: tuple[int, np.ndarray], scale: int) -> np.ndarray:
    return lowest(one[1], scale) if scale > one[0] else one[1]


def merged(one: tuple[int, np.ndarray], other: tuple[int, np.ndarray]) -> tuple[int, np.ndarray]:
    """The sketch of both texts' shingles together."""
    scale = max(one[0], other[0])
    return scale, lowest(np.union1d(at_scale(one, scale), at_scale(other, scale)), scale)


def containment(one: tuple[int, np.ndarray], other: tuple[int, np.ndarray]) -> float:
    """The share of one's shingles that other has, as far as the sketches tell; 0 if they are silent."""
    scale = max(one[0], other[0])
    mine = at_scale(one, scale)
    return float(np.isin(mine, at_scale(other, scale), assume_unique=True).mean()) if len(mine) else 0.0


def likeness(one: tuple[int, np.ndarray], other: tuple[int, np.ndarray]) -> float:
    if one[0] == other[0] and np.array_equal(one[1], other[1]):
        return 1.0
    scale = max(one[0], other[0])
    mine, theirs = at_scale(one, scale), at_scale(other, scale)
    least = min(len(mine), len(theirs))
    return len(np.intersect1d(mine, theirs, assume_unique=True)) / least if least else 0.0


def written(one: tuple[int, np.ndarray]) -> str:
    data = one[1].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BITS // 8 :].tobytes()
    return f"{one[0]}:{base64.b64encode(data).decode()}"


def read(fingerprint: str) -> tuple[int, np.ndarray]:
    scale, _, data = fingerprint.partition(":")
    rows = np.frombuffer(base64.b64decode(data), np.uint8).reshape(-1, HASH_BITS // 8)
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, 8 - HASH_BITS // 8 :] = rows
    return int(scale), wide.reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fingerprint; one row for each input row, no shuffle."""
    from pyspark.sql import types as T

    return map_text(df, text, lambda: lambda texts: {"fingerprint": [written(sketch(x)) for x in texts]}, [("fingerprint", T.StringType())], keep)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_following(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row, in ranges of the key: part, sorted order, text, and for the last
    row of each range a copy of the row that follows it (ahead = true), which is the first of
    the next range.

    The ranges are cut at sampled keys, as a range partitioning does; only their bounds and
    one first key per range, as many as there are partitions, reach the driver. The texts
    are shuffled once. Rows of equal keys stay in one range.
    """
    spark = df.sparkSession
    rows = df.select(quoted(key).alias("key"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numeric = F.coalesce(F.col("key").cast("double"), F.lit(float("-inf")))
    levels = [i / parts for i in range(1, parts)]
    cuts = rows.select(F.percentile_approx(numeric, levels, max(1000, 20 * parts)).alias("q")).first()["q"] if levels else None
    bounds = sorted(set(cuts or []))
    placed = rows.withColumn("part", _bisected(numeric, bounds).cast("int"))
    first = {r["part"]: r["key"] for r in placed.groupBy("part").agg(F.min(F.struct(F.col("key").isNotNull().alias("there"), "key")).alias("m")).select("part", F.col("m.key").alias("key")).collect()}
    there = sorted(first)
    before = {p: there[i - 1] for i, p in enumerate(there)}  # the first range follows the last
    if not there:
        return placed.select("part", F.lit(False).alias("ahead"), "key", "text")
    kind = df.schema[key].dataType
    firsts = F.array(*[F.lit(first.get(p)).cast(kind) for p in range(max(there) + 1)])
    befores = F.array(*[F.lit(before.get(p, 0)) for p in range(max(there) + 1)])
    starts = {"first": F.get(firsts, F.col("part")), "before": F.get(befores, F.col("part"))}
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("ahead"))
    ahead = F.struct(starts["before"].alias("part"), F.lit(True).alias("ahead"))
    copies = F.when(F.col("key").eqNullSafe(starts["first"]), F.array(own, ahead)).otherwise(F.array(own))
    spread = placed.select("key", "text", F.explode(copies).alias("at")).select(F.col("at.part").alias("part"), F.col("at.ahead").alias("ahead"), "key", "text")
    return spread.repartition(parts, "part").sortWithinPartitions("part", "ahead", F.col("key").asc_nulls_first(), "text")


def _bisected(value: F.Column, bounds: list[float]) -> F.Column:
    """How many of the ascending bounds are at most value, by halving."""
    if not bounds:
        return F.lit(0)
    middle = len(bounds) // 2
    return F.when(value < F.lit(bounds[middle]), _bisected(value, bounds[:middle])).otherwise(F.lit(middle + 1) + _bisected(value, bounds[middle + 1 :]))


EDITED_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _report(key: object, text: str, mine: tuple, following: str, theirs: tuple) -> tuple:
    changed = edited(text, following)
    other = mine if changed == text else sketch(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(text), digest, written(mine), written(other), likeness(mine, other), likeness(mine, theirs)


def compare_edits(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    Rows come in order within a range; a task holds two texts at a time besides its batch.
    """
    names = [c.split()[0] for c in EDITED_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = None, None, []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, arrow, strict=True)], names=names)

        arrow = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        for batch in batches:
            for i in range(batch.num_rows):
                part, ahead, key_, text_ = (batch.column(c)[i].as_py() for c in range(4))
                mine = sketch(text_)
                if part != at:
                    held, at = None, part
                if held is not None:
                    out.append(_report(*held, text_, mine))
                held = None if ahead else (key_, text_, mine)
                if len(out) >= 1000:
                    yield flushed()
        if out:
            yield flushed()

    return with_following(df, key, text).mapInArrow(run, EDITED_SCHEMA)


def union(sketches: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """The sketch of a collection, from those of its parts."""
    return reduce(merged, sketches, (min((scale for scale, _ in sketches), default=SCALE), np.empty(0, np.uint64)))
