"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits link at DISTANCE or fewer differing bits. The bits are cut into
BLOCKS parts, of which one differs in at most DISTANCE // BLOCKS = 1 bit for every link.
On each part a covering code gives the anchors: 15 bits of it are covered by the perfect
[15, 11] Hamming code, of covering radius 1, and the others are taken as they are. A
fingerprint's home is its nearest anchor; it is replicated to every anchor within covering
radius plus threshold, 2 bits. Two linked fingerprints then meet at the home of either,
and only there are they compared.

Equal fingerprints are one class, which alone is replicated. Each task reduces the links
that it finds to a forest, so a dense group gives a link for each member and not for each
pair. The number of parts that anchors are dealt to follows the number of classes. An anchor
with more than HOT entries is written once, in slices, and Spark joins each slice of homes
with each slice of entries, every pair of slices a row that any task may compare. Components
come from star steps in Spark; rows get theirs by a join on the fingerprint, in which those
with very many copies are broadcast, of which there can be no more than MOST_HOT.

Defined cases: null text has no words; texts without words have fingerprint zero and are
linked like others; a very long text is hashed in chunks; a component is named by its least
document id, null ids being passed over unless there is no other; repeated rows are in one
component; an empty table gives no rows; other columns may have any name and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmark.llm.common import Scratch, map_text
from driftmark.llm.components import forest, roots
from driftmark.llm.rolling import mixed

DISTANCE = 4
WORDS = 4
SEED = 42
#: Low bit and width of each part.
PARTS = ((0, 22), (22, 21), (43, 21))
CODE = 15
#: Entries of an anchor that one task compares; beyond, slices of so many.
HOT = 100_000
SLICE = 50_000
#: Classes whose anchors are dealt to one part; each has about fifty entries of 16 bytes.
PART_CLASSES = 50_000
#: Copies beyond which a fingerprint's component is broadcast, and the most of these that there
#: are: a fingerprint needs one in MOST_HOT of all rows as well.
HOT_COPIES = 1000
MOST_HOT = 100_000
PAIRS = 1 << 21
CHUNK = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def simhash(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # ASCII white space
    if not words:
        return 0
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    for start in range(0, n, CHUNK):
        part = words[start : start + CHUNK + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum([len(w) + 1 for w in part])
        begins = np.concatenate([[0], ends[:-1]])
        m = len(part) - size + 1
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[:m].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _masks() -> np.ndarray:
    """masks[syndrome]: what to flip to get each codeword within two bits; padded by the first."""
    out = np.zeros((16, 8), np.uint64)
    for s in range(1, 16):
        near = [1 << (s - 1)] + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 16) if i < i ^ s and i != s]
        out[s] = near
    return out


MASKS = _masks()


def syndromes(low: np.ndarray) -> np.ndarray:
    out = np.zeros(len(low), np.uint64)
    for i in range(1, CODE + 1):
        out ^= np.uint64(i) * ((low >> np.uint64(i - 1)) & np.uint64(1))
    return out.astype(np.int64)


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Home anchors (and whose), then all anchors within reach (and whose), for all parts."""
    homes, reach, own, others = [], [], [], []
    index = np.arange(len(values))
    for part, (low_bit, width) in enumerate(PARTS):
        block = (values >> np.uint64(low_bit)) & np.uint64((1 << width) - 1)
        low, high = block & np.uint64((1 << CODE) - 1), block >> np.uint64(CODE)
        s = syndromes(low)
        words = low[:, None] ^ MASKS[s]
        name = np.uint64(part << 32)
        home = name | high << np.uint64(CODE) | words[:, 0]
        homes.append(home)
        own.append(index)
        reach.append(home)
        others.append(index)
        far = s != 0  # a codeword has no other within two bits
        for j in range(1, 8):
            reach.append((name | high << np.uint64(CODE) | words[:, j])[far])
            others.append(index[far])
        for j in range(width - CODE):
            reach.append(home ^ np.uint64(1 << (CODE + j)))
            others.append(index)
    return np.concatenate(homes), np.concatenate(own), np.concatenate(reach), np.concatenate(others)


def compared(home_at: np.ndarray, home: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between homes and entries of equal anchors; both sides sorted by anchor."""
    lo, hi = np.searchsorted(at, home_at, "left"), np.searchsorted(at, home_at, "right")
    sizes = hi - lo
    ends = np.cumsum(sizes)
    found_a, found_b = np.empty(0, np.uint64), np.empty(0, np.uint64)
    start = 0
    while start < len(home):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        n = sizes[start:stop]
        which = np.repeat(np.arange(start, stop), n)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        a, b = home[which], values[lo[which] + offset]
        close = (np.bitwise_count(a ^ b) <= DISTANCE) & (a != b)
        if close.any():
            a, b = forest(a[close], b[close])
            found_a, found_b = np.concatenate([found_a, a]), np.concatenate([found_b, b])
            if len(found_a) > 1 << 20:
                found_a, found_b = forest(found_a, found_b)
        start = stop
    return forest(found_a, found_b)


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _array(parts: list[bytes | None], kind: type = np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(p for p in parts if p), kind)


MET = "kind int, a bigint, b bigint, anchor bigint, side int, slice int, others int, held binary"
_MET = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("anchor", pa.int64()), *[(n, pa.int32()) for n in ("side", "slice", "others")], ("held", pa.binary())])


def _links(a: np.ndarray, b: np.ndarray) -> pa.Table:
    n = len(a)
    columns = [pa.array(np.zeros(n, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))]
    return pa.Table.from_arrays([*columns, *[pa.nulls(n, f.type) for f in list(_MET)[3:]]], schema=_MET)


def _sliced(key: np.uint64, homes: np.ndarray, entries: np.ndarray, size: int) -> pa.Table:
    """Both sides of a crowded anchor, every value once."""
    cuts = [[x[i : i + size] for i in range(0, len(x), size)] for x in (homes, entries)]
    rows = [(1, 0, 0, int(key.view(np.int64)), side, i, len(cuts[1 - side]), _binary(part)) for side in (0, 1) for i, part in enumerate(cuts[side])]
    return pa.Table.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _MET, strict=True)], schema=_MET)


def links(classes: DataFrame, scratch: Scratch, partitions: int) -> DataFrame:
    """(a, b): a forest of the links between distinct fingerprints, a column fp."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK):
                values = batch.column(0).slice(begin, CHUNK).to_numpy(zero_copy_only=False).view(np.uint64)
                home_at, own, at, others = anchors(values)
                sides = []
                for keys, who in ((home_at, own), (at, others)):
                    part = (mixed(keys) % np.uint64(partitions)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    cuts = np.searchsorted(part[order], np.arange(partitions + 1))
                    sides.append((keys[order], values[who[order]], cuts))
                (hk, hv, hc), (ek, ev, ec) = sides
                filled = np.flatnonzero((np.diff(hc) > 0) | (np.diff(ec) > 0)).tolist()
                columns = [[_binary(x[c[p] : c[p + 1]]) for p in filled] for x, c in ((hk, hc), (hv, hc), (ek, ec), (ev, ec))]
                yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["part", "home_at", "home", "at", "entry"])

    def meet(group: pa.Table) -> pa.Table:
        home_at, home, at, entry = (_array(group.column(n).to_pylist()) for n in ("home_at", "home", "at", "entry"))
        order = np.argsort(at, kind="stable")
        at, entry = at[order], entry[order]
        order = np.argsort(home_at, kind="stable")
        home_at, home = home_at[order], home[order]
        crowd = np.searchsorted(at, home_at, "right") - np.searchsorted(at, home_at, "left")
        hot = crowd > HOT
        out = [_links(*compared(home_at[~hot], home[~hot], at, entry))]
        for key in np.unique(home_at[hot]):
            mine = slice(*np.searchsorted(home_at, [key, key + np.uint64(1)]))
            around = slice(*np.searchsorted(at, [key, key + np.uint64(1)]))
            out.append(_sliced(key, home[mine], entry[around], SLICE))
        return pa.concat_tables(out)

    def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                home, entry = (_array([batch.column(n)[i].as_py()]) for n in ("home", "entry"))
                a, b = compared(np.zeros(len(home), np.uint64), home, np.zeros(len(entry), np.uint64), entry)
                yield from _links(a, b).select(["a", "b"]).to_batches()

    spread = classes.select("fp").mapInArrow(replicate, "part int, home_at binary, home binary, at binary, entry binary")
    met = scratch.write(spread.groupBy("part").applyInArrow(meet, MET))
    plain = met.filter("kind = 0").select("a", "b")
    slices = met.filter("kind = 1")
    if slices.limit(1).count() == 0:
        return plain
    # slice i of the homes and j of the entries
    every = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    homes = slices.filter("side = 0").select("anchor", F.col("slice").alias("i"), every.alias("j"), F.col("held").alias("home"))
    entries = slices.filter("side = 1").select("anchor", every.alias("i"), F.col("slice").alias("j"), F.col("held").alias("entry"))
    pairs = homes.join(entries, ["anchor", "i", "j"]).select("home", "entry")
    return plain.unionByName(pairs.mapInArrow(crowded, "a bigint, b bigint"))


def fingerprints(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "fp") -> DataFrame:
    """The kept columns and the fingerprint (bigint); one row for each input row, no shuffle."""

    def make() -> object:
        return lambda texts: {name: np.array([simhash(x) for x in texts], np.uint64).view(np.int64)}

    return map_text(df, text, make, [(name, T.LongType())], keep)


def components(hashed: DataFrame, scratch: Scratch) -> DataFrame:
    """For each fp of (key, fp): root (of all that are linked), component (their least key), first
    (its own least key) and copies (its rows)."""
    classes = scratch.write(hashed.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("copies")))
    partitions = max(int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-classes.count() // PART_CLASSES))
    found = roots(links(classes, scratch, partitions), scratch)
    named = found.join(classes, F.col("node") == F.col("fp")).select("fp", "root", "first")
    whole = named.unionByName(classes.join(found.select(F.col("root").alias("fp")).distinct(), "fp").select("fp", F.col("fp").alias("root"), "first"))
    least = whole.groupBy("root").agg(F.min("first").alias("least"))
    joined = whole.join(least, "root").select("fp", "root", "least")
    told = classes.join(joined, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component"), "first", "copies")
    return scratch.write(told)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (bigint), component (least key of all that are linked); a row for each row."""
    scratch = Scratch(df.sparkSession)
    hashed = scratch.write(fingerprints(df, text, [key]).withColumnRenamed(key, "key"))
    told = components(hashed, scratch)
    rows = told.agg(F.sum("copies").alias("n")).first()["n"] or 0
    hot = F.col("copies") > max(HOT_COPIES, rows // MOST_HOT)  # MOST_HOT fingerprints at most
    crowds = F.broadcast(told.filter(hot).select("fp", "component"))
    alone = hashed.join(F.broadcast(told.filter(hot).select("fp")), "fp", "left_anti").join(told.filter(~hot).select("fp", "component"), "fp")
    both = hashed.join(crowds, "fp").select("key", "fp", "component").unionByName(alone.select("key", "fp", "component"))
    return both.withColumnRenamed("key", key)
