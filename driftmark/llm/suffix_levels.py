"""Suffix-array dedup by a logarithmic family of indexes.

A level is a Parquet table of sampled suffixes in sorted order: for each anchor (see repeats)
that several documents hold, the WINDOW bytes from the anchor on, then the bytes before it,
as far as the windows that share this anchor reach, and the least document that has them. A
new batch of documents gets a suffix array of its own, is merge-scanned against every level,
and joins the family: levels of equal size merge with it, so n batches leave at most log n
levels and each suffix is rewritten log n times.

Where the suffixes of one anchor are equal on both sides they match from end to end. Where
they differ, every window that they reach over is a suffix of its own; these are sorted, byte
by byte, and each gets the least document of its equals. All bytes that are removed are
removed by a match that a scan found, in a level or in the batch itself; long matches are
runs of windows, joined where they touch. Batches come in ascending order of their documents,
so a level only ever holds lesser ones.

The family is distributed by anchors: equal windows have equal anchors, so they meet in one
part, of which there are as many as the bytes ask for; an anchor that has very many different
surroundings is cut into single windows, which are sampled suffixes of their own and are dealt
by their content. Before a batch is sent, the equal
suffixes of a home are one row, compared byte by byte, with their places kept at the home.

Defined cases: null text is empty and keeps nothing; texts of fewer than WINDOW bytes
lose nothing; rows of equal ids are no lesser document to each other, whether their texts are
equal or not, and each row only loses what itself shares with a lesser id; rows without an id
come out whole and cut nothing; a very long text is read in portions; an empty table gives no
rows; other columns may have any name and are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch, quoted
from driftmark.llm.repeats import WINDOW, Repeats, as_table, binary, byte_units, crowded, dealt, filled, flat, pack_ids, single_windows, span_hashes, unfolded, unpack_ids, within

ANCHOR = 20
#: Bytes that the windows of one anchor reach before it.
BEFORE = WINDOW - ANCHOR
#: Windows that are sorted at a time, unless one anchor has more.
SORTED = 1 << 18
#: A suffix: WINDOW bytes from the anchor, BEFORE bytes before it, padded; bytes before the anchor, and in all.
WIDTH = WINDOW + BEFORE + 2


def records(data: np.ndarray, start: np.ndarray, count: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The suffixes of pieces, as rows of WIDTH bytes."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(WINDOW, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + WINDOW)[place]
    column = np.arange(BEFORE + WINDOW)[None]
    left, size = place - start, count + WINDOW - 1
    inside = (column >= (BEFORE - left)[:, None]) & (column < (BEFORE - left + size)[:, None])
    around = np.where(inside, around, 0).astype(np.uint8)
    return np.hstack([around[:, BEFORE:], around[:, :BEFORE], left[:, None].astype(np.uint8), size[:, None].astype(np.uint8)])


def counts_of(rows: np.ndarray) -> np.ndarray:
    return rows[:, -1].astype(np.int64) - (WINDOW - 1)


def windows_of(rows: np.ndarray) -> np.ndarray:
    """All windows of suffixes, one after the other, as strings that end in a byte of one."""
    text = np.hstack([rows[:, WINDOW : WINDOW + BEFORE], rows[:, :WINDOW]])
    n = counts_of(rows)
    which = np.repeat(np.arange(len(rows)), n)
    column = BEFORE - rows[:, -2].astype(np.int64)[which] + within(n)
    wide = np.ones((len(which), WINDOW + 1), np.uint8)
    wide[:, :WINDOW] = np.lib.stride_tricks.sliding_window_view(text, WINDOW, axis=1)[which, column]
    return wide.reshape(-1).view(f"S{WINDOW + 1}")


def starts_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin; of rows of a matrix, of equal rows."""
    if not len(keys):
        return np.empty(0, np.int64)
    changed = keys[1:] != keys[:-1]
    return np.flatnonzero(np.concatenate([[True], changed.any(1) if changed.ndim > 1 else changed]))


def matched(key: np.ndarray, rows: np.ndarray, doc: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, first window, last window + 1, least document of those windows) for the asked suffixes.

    key: the anchor of each suffix; those of anchors that nothing asks for are passed over.
    """
    order = np.argsort(key, kind="stable")
    order = order[np.isin(key[order], key[asked])]
    first = starts_of(key[order])
    sizes = np.diff(np.append(first, len(order)))
    group = np.repeat(np.arange(len(first)), sizes)
    same = (rows[order] == rows[order[first[group]]]).all(1) if len(order) else np.empty(0, bool)
    alike = np.logical_and.reduceat(same, first)[group] if len(order) else same
    least = np.minimum.reduceat(doc[order], first)[group] if len(order) else doc[order]
    told = alike & asked[order]
    out = [(order[told], np.zeros(told.sum(), np.int64), counts_of(rows[order[told]]), least[told])]
    # anchors whose suffixes differ: window by window, some anchors at a time
    rest = order[~alike]
    total = np.cumsum(counts_of(rows[rest]))
    begins = starts_of(key[rest])
    at = 0
    while at < len(begins):
        done = total[begins[at] - 1] if begins[at] else 0
        ends = np.append(begins[1:], len(rest))
        stop = max(at + 1, int(np.searchsorted(total[ends - 1], done + SORTED, "right")))
        part = rest[begins[at] : ends[stop - 1]]
        n = counts_of(rows[part])
        owner = np.repeat(part, n)
        suffixes = windows_of(rows[part])
        by = np.argsort(suffixes, kind="stable")
        heads = starts_of(suffixes[by])
        lowest = np.empty(len(by), np.int64)
        lowest[by] = np.repeat(np.minimum.reduceat(doc[owner][by], heads), np.diff(np.append(heads, len(by))))
        wanted = asked[owner]
        owner, offset, lowest = owner[wanted], within(n)[wanted], lowest[wanted]
        runs = starts_of(np.stack([owner, lowest], 1))
        if len(runs):
            out.append((owner[runs], offset[runs], offset[np.append(runs[1:] - 1, len(owner) - 1)] + 1, lowest[runs]))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged(key: np.ndarray, rows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted run of several: equal suffixes once, with their least document."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").reshape(-1).view(f"S{rows.shape[1]}") if len(rows) else doc, kind="stable")
    key, rows, doc = key[order], rows[order], doc[order]
    first = starts_of(rows)
    return key[first], rows[first], np.minimum.reduceat(doc, first) if len(first) else doc


LEVEL = "part int, key bigint, record binary, doc bigint"
SCANNED = "kind int, part int, key bigint, record binary, doc bigint, home int, pieces binary, starts binary, ends binary, least binary"


class SuffixLevels:
    """The family: sorted suffixes on storage, in levels of geometrically growing size."""

    def __init__(self, scratch: Scratch, spread: Callable[[DataFrame, str], DataFrame]) -> None:
        self.scratch, self.spread = scratch, spread
        #: (batches, table) of each level, the largest first.
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """What is repeated of a batch of suffixes (part, key, record, doc, last, home, piece), of
        which no doc may be less than those of earlier batches: (home, pieces, starts, ends,
        least), packed: windows of a piece and the least document that has them, where that is
        less than the last document that has the piece. The batch then is part of the family; a
        last one only is scanned.
        """
        size, merging = 1, []
        for batches, _ in reversed(self.levels):
            if batches != size:
                break
            merging.append(len(self.levels) - 1 - len(merging))
            size *= 2
        joining = [] if last else [-1, *merging]

        def scan(group: pa.Table) -> pa.Table:
            level = group.column("level").to_numpy()
            key, doc = (group.column(n).to_numpy() for n in ("key", "doc"))
            rows = flat(group.column("record"))[0].reshape(-1, WIDTH)
            which, start, end, least = matched(key, rows, doc, level == -1)
            final = group.column("last").to_numpy()
            late = least < final[which]
            which, start, end, least = which[late], start[late], end[late], least[late]
            home, piece = (group.column(n).to_numpy().astype(np.int64) for n in ("home", "piece"))
            packed = [(1, h, *map(pack_ids, x)) for h, *x in dealt(home[which], piece[which], start, end, least)]
            columns = list(zip(*packed, strict=True)) if packed else [[] for _ in range(6)]
            out = filled(SCANNED, len(packed), **dict(zip(("kind", "home", "pieces", "starts", "ends", "least"), columns, strict=True)))
            if not joining:
                return out
            chosen = np.isin(level, joining)
            key, rows, doc = merged(key[chosen], rows[chosen], doc[chosen])
            held = filled(SCANNED, len(doc), kind=np.zeros(len(doc), np.int32), part=np.full(len(doc), group.column("part")[0].as_py(), np.int32), key=key, record=binary(rows), doc=doc)
            return pa.concat_tables([out, held])

        rows = batch.select(F.lit(-1).alias("level"), "part", "key", "record", "doc", "last", "home", "piece")
        for i, (_, table) in enumerate(self.levels):
            nothing = F.lit(0)
            rows = rows.unionByName(table.select(F.lit(i).alias("level"), "part", "key", "record", "doc", nothing.cast("long").alias("last"), nothing.alias("home"), nothing.alias("piece")))
        out = self.scratch.write(self.spread(rows, "part").groupBy("part").applyInArrow(scan, SCANNED))
        if not last:
            self.levels = [x for i, x in enumerate(self.levels) if i not in merging]
            self.levels.append((size, out.filter("kind = 0").select("part", "key", "record", "doc")))
        return out.filter("kind = 1").select("home", "pieces", "starts", "ends", "least")


FOUND = "kind int, home int, part int, batch int, key bigint, record binary, doc bigint, last bigint, piece int, pieces binary, texts binary, places binary"


def suffixes(repeats: Repeats) -> DataFrame:
    """kind 0: the distinct suffixes of each home; kind 1, packed: where they are in its texts."""
    parts, cuts = repeats.parts, repeats.cuts

    def look(home: int, ids: np.ndarray, texts: list[bytes], found: Callable) -> pa.Table:
        listed = []
        for portion, owner, start, place, count, anchor, at in found():
            listed.append((owner, place, anchor, span_hashes(portion, start, start + count + WINDOW - 1), records(portion, start, count, at)))
        if not listed:
            return as_table([], FOUND)
        owner, place, anchor, name, rows = (np.concatenate(x) for x in zip(*listed, strict=True))
        order = np.lexsort((place, owner, name))
        owner, place, anchor, name, rows = (x[order] for x in (owner, place, anchor, name, rows))
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (rows[1:] != rows[:-1]).any(1)])
        first = np.flatnonzero(new)
        least, last = ids[owner[first]], ids[owner[np.append(first[1:] - 1, len(owner) - 1)]]  # texts are in order of their ids
        n = len(first)
        part = ((anchor[first] >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        batch = np.searchsorted(cuts, least, "right").astype(np.int32)
        held = filled(FOUND, n, kind=np.zeros(n, np.int32), home=np.full(n, home, np.int32), part=part, batch=batch, key=anchor[first].view(np.int64), record=binary(rows[first]), doc=least, last=last, piece=np.arange(n, dtype=np.int32))
        where = filled(FOUND, 1, kind=[1], home=[home], pieces=[pack_ids(np.cumsum(new) - 1)], texts=[pack_ids(owner)], places=[pack_ids(place)])
        return pa.concat_tables([held, where])

    return repeats.candidates(look, FOUND)


def cut_up(repeats: Repeats, found: DataFrame) -> DataFrame:
    """The suffixes of crowded anchors as single windows, which have negative numbers at their
    home; kind 2, packed: which suffixes have them, and where."""
    parts, cuts = repeats.parts, repeats.cuts

    def divide(group: pa.Table) -> pa.Table:
        rows = flat(group.column("record"))[0].reshape(-1, WIDTH)
        doc, last, piece = (group.column(n).to_numpy().astype(np.int64) for n in ("doc", "last", "piece"))
        n = counts_of(rows)
        owner, offset = np.repeat(np.arange(len(n)), n), within(n)
        text = windows_of(rows).view(np.uint8).reshape(-1, WINDOW + 1)[:, :WINDOW]
        each = np.arange(len(text)) * WINDOW
        name = span_hashes(text.reshape(-1), each, each + WINDOW)
        first, latest, number = single_windows(owner, name, text, doc, last)
        m, home = len(first), group.column("home")[0].as_py()
        nothing = np.zeros(m, np.int64)
        held = filled(
            FOUND, m, kind=np.zeros(m, np.int32), home=np.full(m, home, np.int32), part=((name[first] >> np.uint64(32)) % np.uint64(parts)).astype(np.int32),
            batch=np.searchsorted(cuts, doc[owner[first]], "right").astype(np.int32), key=name[first].view(np.int64), doc=doc[owner[first]], last=latest, piece=-np.arange(1, m + 1, dtype=np.int32),
            record=binary(np.hstack([text[first], np.zeros((m, BEFORE), np.uint8), np.stack([nothing, nothing + WINDOW], 1).astype(np.uint8)])),
        )
        where = filled(FOUND, 1, kind=[2], home=[home], pieces=[pack_ids(piece[owner])], texts=[pack_ids(number)], places=[pack_ids(offset)])
        return pa.concat_tables([held, where])

    return repeats.spread(found, "home").groupBy("home").applyInArrow(divide, FOUND)


TOLD = ("kind", "pieces", "texts", "places", "starts", "ends", "least")


def removed_spans(ids: np.ndarray, _: list[bytes], told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end): places of pieces in texts whose id is above the least document of their windows.

    kind 1: places, 2: suffixes that were cut up, 3: what the levels told.
    """
    kinds = told.column("kind").to_pylist()

    def column(name: str, kind: int) -> np.ndarray:
        return unpack_ids([x for x, k in zip(told.column(name).to_pylist(), kinds, strict=True) if k == kind])

    piece, text, place = (column(n, 1) for n in ("pieces", "texts", "places"))
    single = tuple(column(n, 2) for n in ("pieces", "places", "texts"))
    asked, start, end, least = (column(n, 3) for n in ("pieces", "starts", "ends", "least"))
    which, asked, start, end = unfolded(asked, start, end, single)
    least = least[which]
    order = np.argsort(piece, kind="stable")
    piece, text, place = piece[order], text[order], place[order]
    lo, hi = np.searchsorted(piece, asked, "left"), np.searchsorted(piece, asked, "right")
    which, at = np.repeat(np.arange(len(asked)), hi - lo), np.repeat(lo, hi - lo) + within(hi - lo)
    late = ids[text[at]] > least[which]
    which, at = which[late], at[late]
    return text[at], place[at] + start[which], place[at] + end[which] + (WINDOW - 1)


def cut(text: bytes, spans: np.ndarray) -> bytes:
    """The text without the spans."""
    if not len(spans):
        return text
    parts, at = [], 0
    for start, end in spans.tolist():
        parts.append(text[at:start])
        at = end
    return b"".join(parts) + text[at:]


RESULT = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256; a row for each row.

    The collection goes through the family in batches, which are ranges of the ids.
    """
    scratch = Scratch(df.sparkSession)
    repeats = Repeats(df.select(quoted(key).alias("key"), quoted(text).alias("text")), byte_units, ANCHOR)
    found = scratch.write(suffixes(repeats))
    candidates, told = found.filter("kind = 0"), found.filter("kind = 1")
    if (anchors := crowded(found, "key")) is not None:
        divided = scratch.write(cut_up(repeats, candidates.join(F.broadcast(anchors), "key", "left_semi")))
        candidates = candidates.join(F.broadcast(anchors), "key", "left_anti").unionByName(divided.filter("kind = 0"))
        told = told.unionByName(divided.filter("kind = 2"))
    told = told.select("home", *[F.col(n) if n in found.columns else F.lit(None).cast("binary").alias(n) for n in TOLD])
    family = SuffixLevels(scratch, repeats.spread)
    batches = len(repeats.cuts) + 1
    for number in range(batches):
        repeated = family.add(candidates.filter(F.col("batch") == number), last=number + 1 == batches)
        told = told.unionByName(repeated.withColumns({"kind": F.lit(3), "texts": F.lit(None).cast("binary"), "places": F.lit(None).cast("binary")}))

    def report(doc: int | None, text: bytes, removed: np.ndarray) -> tuple:
        return doc, len(text), int((removed[:, 1] - removed[:, 0]).sum()), len(removed), hashlib.sha256(cut(text, removed)).hexdigest()

    return repeats.finished(told, removed_spans, report, RESULT).withColumnRenamed("doc", key)
