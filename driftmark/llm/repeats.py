"""Where documents may repeat each other: minimiser anchors that several documents hold.

The least hash of the k-unit strings inside a window depends on the window's content alone,
so two equal windows of any documents have equal anchors. A document is cut into pieces,
the runs of windows that share one anchor; only pieces whose anchor occurs in two documents
can hold a repeated window, and only these need a closer look.

Anchors are sent as packed arrays, not as rows. A map task sends each anchor of its share
once, however many of its documents hold it, so an anchor of a common passage costs an
entry for each map task and not for each document; what repeats inside the share is known
there at once. Documents and findings meet at homes, by a hash of the document's id; homes
and parts are as many as the bytes of the collection ask for. Within a home a text is known
by its place among the distinct (id, text) of that home, so rows that share an id stay apart
and repeated rows are read once.

Units are bytes or hashed words, WINDOW units make a window. Rows without an id take no
part: they repeat nothing and are repeated by nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.rolling import _BASE, mixed, window_minima, windows

WINDOW = 50
#: Units of one pass of the vectorised functions; below 2**24, the positions of a pass.
PORTION = 1 << 18
#: Anchors that a map task gathers before it sends them.
GATHERED = 1 << 19
#: Bytes of text of one home, and of the texts whose anchors go to one part.
HOME_BYTES = 8 << 20
PART_BYTES = 8 << 20
LEAST_GROUPS = 4
#: Bytes of text of one task, where the session's number of shuffle partitions is too low for it.
TASK_BYTES = 64 << 20
_PLACE = np.uint64((1 << 24) - 1)
_ORDER = np.uint64(~((1 << 24) - 1) & (1 << 64) - 1)

Units = Callable[[list[bytes]], list[np.ndarray]]


def byte_units(texts: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint8) for t in texts]


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * PORTION)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of units[start:end]: equal spans have equal hashes wherever they stand."""
    up, down = _power_tables(len(units) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[: len(units)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) << np.uint64(40))


def word_units(texts: list[bytes]) -> list[np.ndarray]:
    """Hashed words of each text; words are runs of bytes other than ASCII white space."""
    out: list[np.ndarray] = []
    for text in texts:
        parts = []
        at = 0
        while at < len(text):
            end = at + PORTION
            while end < len(text) and not _SPACE[text[end]]:  # not inside a word
                end += 1
            data = np.frombuffer(text, np.uint8)[at:end]
            gap = np.concatenate([[True], _SPACE[data], [True]])
            edges = np.flatnonzero(gap[1:] != gap[:-1])
            parts.append(span_hashes(data, edges[::2], edges[1::2]))
            at = end
        out.append(parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64))
    return out


def packs(texts: list[bytes], limit: int = PORTION) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in turn, about limit bytes at a time, with the index of the first."""
    held: list[bytes] = []
    first = size = 0
    for i, text in enumerate(texts):
        if held and size + len(text) > limit:
            yield first, held
            held, first, size = [], i, 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def portions(arrays: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(units, owners, bases, bounds): segments of the arrays end to end, each whole windows.

    An array longer than PORTION is cut into segments that overlap by a window less a unit.
    """
    held: list[np.ndarray] = []
    owners: list[int] = []
    bases: list[int] = []
    size = 0

    def full() -> tuple:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        return np.concatenate(held), np.array(owners), np.array(bases), bounds

    for i, units in enumerate(arrays):
        for base in range(0, max(0, len(units) - WINDOW + 1), PORTION):
            piece = units[base : base + PORTION + WINDOW - 1]
            if held and size + len(piece) > PORTION:
                yield full()
                held, owners, bases, size = [], [], [], 0
            held.append(piece)
            owners.append(i)
            bases.append(base)
            size += len(piece)
    if held:
        yield full()


def pieces(units: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, segment, start, count, place) of the runs of windows that share an anchor's place."""
    hashes = windows(units, k)
    placed = hashes & _ORDER | np.arange(len(hashes), dtype=np.uint64)
    least = window_minima(placed, WINDOW - k + 1)
    segment = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    starts = np.flatnonzero(segment[: len(least)] == segment[WINDOW - 1 :])
    least, segment = least[starts], segment[starts]
    if not len(starts):
        return np.empty(0, np.uint64), segment, starts, starts, starts
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (segment[1:] != segment[:-1])]))
    count = np.diff(np.append(first, len(starts)))
    place = (least[first] & _PLACE).astype(np.int64)
    return hashes[place], segment[first], starts[first], count, place


def tokens_of(anchors: np.ndarray, parts: int) -> np.ndarray:
    """A shorter name of anchors, its part in the upper half; rare clashes only cost a closer look."""
    return ((anchors >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | anchors & np.uint64(0xFFFFFFFF)


def pairs_of(docs: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(mixed(docs.view(np.uint64)) + tokens)


def home_of(docs: np.ndarray, homes: int) -> np.ndarray:
    return np.mod(docs ^ docs >> 7 ^ docs >> 17, homes)


def home_column(doc: Column, homes: int) -> Column:
    """home_of() as a column expression."""
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 7)).bitwiseXOR(F.shiftright(doc, 17)), F.lit(homes)).cast("int")


def pack_ids(values: np.ndarray) -> bytes:
    """64-bit values byte by byte of each place, which compresses well where high bytes agree."""
    return np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_ids(data: list[bytes | None]) -> np.ndarray:
    parts = [np.ascontiguousarray(np.frombuffer(d, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1) for d in data if d]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def unpack(data: list[bytes | None], kind: object) -> np.ndarray:
    return np.frombuffer(b"".join(d for d in data if d), kind)


def dealt(where: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(number, parts of the arrays) for each value of where that occurs."""
    if not len(where):
        return
    order = np.argsort(where, kind="stable")
    where = where[order]
    arrays = [a[order] for a in arrays]
    cuts = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    for start, stop in zip(cuts.tolist(), [*cuts[1:].tolist(), len(where)], strict=True):
        yield int(where[start]), *[a[start:stop] for a in arrays]


def binary(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a matrix of bytes."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls end to end, and the length of each value."""
    parts, sizes = [np.empty(0, np.uint8)], [np.empty(0, np.int64)]
    for chunk in column.cast(pa.binary()).chunks:
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1] if len(chunk) else np.zeros(1, np.int32)
        if len(chunk) and ends[-1] > ends[0]:
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]])
        sizes.append(np.diff(ends).astype(np.int64))
    return np.concatenate(parts), np.concatenate(sizes)


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


#: Different surroundings of one anchor beyond which it is crowded, if they are one in
#: MOST_CROWDED of all as well; so there are no more crowded anchors than that.
CROWD = 20_000
MOST_CROWDED = 100_000


def crowded(found: DataFrame, anchor: str) -> DataFrame | None:
    """The crowded anchors of (kind 0) candidates, few enough to broadcast; None if there are none.

    What stands around a passage that very many documents share differs from one to the next,
    so the anchors at its ends are crowded. Their candidates are cut into single windows, which
    are dealt by their own content: no anchor's surroundings meet in one task.
    """
    counts = found.filter("kind = 0").groupBy(anchor).agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
    if not counts.limit(1).count():
        return None
    total = found.filter("kind = 0").count()
    return counts.filter(F.col("n") > total // MOST_CROWDED).select(anchor)


def single_windows(owner: np.ndarray, name: np.ndarray, content: np.ndarray, doc: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal windows of one home once: the first of each in order of document, the last document
    that has it, and the number of each given window's own, from 1.

    owner: the candidate that each window is from, with doc and last; name: a hash of its content.
    """
    order = np.lexsort((doc[owner], name))
    new = np.concatenate([[True], (name[order][1:] != name[order][:-1]) | (content[order][1:] != content[order][:-1]).reshape(len(order) - 1, -1).any(1)])
    first = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)
    return order[first], np.maximum.reduceat(last[owner][order], first), number


def unfolded(asked: np.ndarray, first: np.ndarray, end: np.ndarray, cut: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(which answer, piece, first, end) where answers on single windows, whose pieces are negative,
    are told for the pieces that they were cut from.

    cut: piece, offset and the single window's number for all windows of pieces that were cut.
    """
    piece, offset, number = cut
    order = np.argsort(number, kind="stable")
    whole, single = np.flatnonzero(asked >= 0), np.flatnonzero(asked < 0)
    lo, hi = (np.searchsorted(number[order], -asked[single], side) for side in ("left", "right"))
    at = order[np.repeat(lo, hi - lo) + within(hi - lo)]
    which = np.concatenate([whole, np.repeat(single, hi - lo)])
    return which, np.concatenate([asked[whole], piece[at]]), np.concatenate([first[whole], offset[at]]), np.concatenate([end[whole], offset[at] + 1])


KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def schema_of(schema: str) -> pa.Schema:
    return pa.schema([(f.split()[0], KINDS[f.split()[1]]) for f in schema.split(", ")])


def filled(schema: str, n: int, **columns: object) -> pa.Table:
    """n rows under a schema; columns that are not given are null."""
    fields = schema_of(schema)
    return pa.Table.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in fields], schema=fields)


def as_table(rows: list[tuple], schema: str) -> pa.Table:
    """Rows under a schema of int, bigint, string and binary columns."""
    fields = schema_of(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)


def distinct(docs: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The ids and texts of a home's distinct (id, text) in order, and the place of each row among them."""
    ids = docs.column("doc").to_pylist()
    texts = docs.column("text").cast(pa.binary()).to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    place, kept = np.empty(len(ids), np.int64), []
    for i in order:
        if not kept or ids[kept[-1]] != ids[i] or texts[kept[-1]] != texts[i]:
            kept.append(i)
        place[i] = len(kept) - 1
    return np.array([ids[i] for i in kept], np.int64), [texts[i] for i in kept], place


class Repeats:
    """Candidates of one collection: documents, and the anchors that they share with others."""

    def __init__(self, docs: DataFrame, units: Units, k: int, key: str = "key", text: str = "text", levels: Sequence[float] = (0.25, 0.5, 0.75)) -> None:
        self.units, self.k = units, k
        kept = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        self.without_id = kept.filter(F.col("doc").isNull())
        self.docs = kept.filter(F.col("doc").isNotNull())
        told = self.docs.agg(F.sum(F.octet_length("text")).alias("n"), F.percentile_approx("doc", list(levels), 1000).alias("cuts")).first()
        size = told["n"] or 0
        #: Ids that cut the documents into ranges of about equal numbers.
        self.cuts = np.array(told["cuts"] or [], np.int64)
        self.homes = max(LEAST_GROUPS, -(-size // HOME_BYTES))
        self.parts = max(LEAST_GROUPS, -(-size // PART_BYTES))
        self.tasks = -(-size // TASK_BYTES)

    def spread(self, df: DataFrame, by: str) -> DataFrame:
        """Rows by a column, in enough tasks for the collection."""
        few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(self.tasks, by) if self.tasks > few else df

    def at_home(self) -> DataFrame:
        return self.docs.select(home_column(F.col("doc"), self.homes).alias("home"), "doc", "text")

    def shared(self) -> DataFrame:
        """(home, docs, tokens): packed pairs of a document and an anchor that another document holds."""
        parts, homes, units, k = self.parts, self.homes, self.units, self.k

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            size = 0

            def send() -> pa.RecordBatch:
                anchor, doc = (np.concatenate(x) for x in zip(*found, strict=True))
                found.clear()
                order = np.lexsort((doc, anchor))
                anchor, doc = anchor[order], doc[order]
                new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
                own = new | np.concatenate([[True], doc[1:] != doc[:-1]])
                anchor, doc, new = anchor[own], doc[own], new[own]
                group = np.cumsum(new) - 1
                several = np.bincount(group)[group] > 1
                rows = [(0, p, pack_ids(d), t.astype("<u4").tobytes()) for p, d, t in dealt((tokens_of(anchor[new], parts) >> np.uint64(32)).astype(np.int64), doc[new], tokens_of(anchor[new], parts) & np.uint64(0xFFFFFFFF))]
                rows += [(1, h, pack_ids(d), pack_ids(t.view(np.int64))) for h, d, t in dealt(home_of(doc[several], homes), doc[several], tokens_of(anchor[several], parts))]
                columns = list(zip(*rows, strict=True))
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["kind", "at", "docs", "tokens"])

            for batch in batches:
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                for first, held in packs(texts):
                    for portion, owners, _, bounds in portions(units(held)):
                        anchor, segment, _, _, _ = pieces(portion, bounds, k)
                        if len(anchor):
                            found.append((anchor, ids[first + owners[segment]]))
                            size += len(anchor)
                    if size >= GATHERED:
                        yield send()
                        size = 0
            if found:
                yield send()

        def meet(group: pa.Table) -> pa.Table:
            kinds = group.column("kind").to_pylist()
            at = group.column("at")[0].as_py() if group.num_rows else 0
            docs, tokens = group.column("docs").to_pylist(), group.column("tokens").to_pylist()
            rows = [(at, d, t) for kind, d, t in zip(kinds, docs, tokens, strict=True) if kind == 1]
            doc = unpack_ids([d for kind, d in zip(kinds, docs, strict=True) if kind == 0])
            token = unpack([t for kind, t in zip(kinds, tokens, strict=True) if kind == 0], "<u4")
            order = np.lexsort((doc, token))
            doc, token = doc[order], token[order]
            if len(doc):
                new = np.concatenate([[True], token[1:] != token[:-1]])
                group_of = np.cumsum(new) - 1
                last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
                several = (doc[new] != doc[last])[group_of]  # sorted: two documents at least
                whole = token[several].astype(np.int64) | np.int64(at) << 32
                rows += [(h, pack_ids(d), pack_ids(t)) for h, d, t in dealt(home_of(doc[several], homes), doc[several], whole)]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["home", "docs", "tokens"])

        sent = self.docs.mapInArrow(gather, "kind int, at int, docs binary, tokens binary")
        return self.spread(sent, "at").groupBy("at").applyInArrow(meet, "home int, docs binary, tokens binary")

    def candidates(self, make: Callable[[int, np.ndarray, list[bytes], Callable], pa.Table], schema: str) -> DataFrame:
        """What make() gives for the documents of each home.

        make(home, ids, texts, found) gets the home's distinct texts and found(), which yields
        (portion of units, place of the text, start in the portion, start in the text, count,
        anchor, anchor's place in the portion) of all candidate pieces.
        """
        parts, units, k = self.parts, self.units, self.k

        def look(docs: pa.Table, hits: pa.Table) -> pa.Table:
            if not docs.num_rows or not hits.num_rows:
                return as_table([], schema)
            ids, texts, _ = distinct(docs)
            known = np.unique(pairs_of(unpack_ids(hits.column("docs").to_pylist()), unpack_ids(hits.column("tokens").to_pylist()).view(np.uint64)))

            def found() -> Iterator[tuple]:
                for first, held in packs(texts):
                    for portion, owners, bases, bounds in portions(units(held)):
                        anchor, segment, start, count, place = pieces(portion, bounds, k)
                        owner = first + owners[segment]
                        pair = pairs_of(ids[owner], tokens_of(anchor, parts))
                        at = np.searchsorted(known, pair)
                        at[at == len(known)] = 0
                        hit = known[at] == pair
                        if hit.any():
                            segment, start = segment[hit], start[hit]
                            yield portion, owner[hit], start, start - bounds[segment] + bases[segment], count[hit], anchor[hit], place[hit]

            return make(docs.column("home")[0].as_py(), ids, texts, found)

        return self.with_texts(self.shared(), look, schema)

    def with_texts(self, packed: DataFrame, visit: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """Documents (doc, text) and packed rows of each home, seen together."""
        texts, rows = self.spread(self.at_home(), "home"), self.spread(packed, "home")
        return texts.groupBy("home").cogroup(rows.groupBy("home")).applyInArrow(visit, schema)

    def finished(self, told: DataFrame, spans: Callable[[np.ndarray, list[bytes], pa.Table], tuple], make: Callable[[int | None, bytes, np.ndarray], tuple], schema: str) -> DataFrame:
        """A row for each document: make(id, text, removed spans), spans disjoint and ascending.

        spans(ids, texts, told rows of the home) gives (place of the text, start, end), which may overlap.
        """

        def apply(docs: pa.Table, rows: pa.Table) -> pa.Table:
            if not docs.num_rows:
                return as_table([], schema)
            ids, texts, place = distinct(docs)
            at, start, end = spans(ids, texts, rows)
            order = np.lexsort((start, at))
            at, start, end = at[order], start[order], end[order]
            bounds = np.searchsorted(at, np.arange(len(ids) + 1))
            done = [make(key, text, united(start[lo:hi], end[lo:hi])) for key, text, lo, hi in zip(ids.tolist(), texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            return as_table([done[p] for p in place.tolist()], schema)

        def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            none = np.empty((0, 2), np.int64)
            for batch in batches:
                texts = batch.column(1).cast(pa.binary())
                yield from as_table([make(None, t.as_py(), none) for t in texts], schema).to_batches()

        done = self.with_texts(told, apply, schema)
        return done.unionByName(self.without_id.mapInArrow(untouched, schema))


def united(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of spans sorted by start, as rows (start, end) that do not touch."""
    if not len(start):
        return np.empty((0, 2), np.int64)
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([start[first], reach[np.append(first[1:] - 1, len(start) - 1)]], 1)
