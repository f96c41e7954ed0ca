"""Substring dedup on a De Bruijn graph of tokens.

Tokens are words. A k-mer of WINDOW tokens is an edge from its first to its last WINDOW - 1
tokens; an edge that a lesser document has too is repeated. Only k-mers around an anchor that
two documents hold (see repeats) are looked at, in runs that share the anchor.

1. Edges: in the part of an anchor, every k-mer of its runs gets its source coordinate, the
   least document that has it and the place of its first occurrence there. Runs of an anchor
   that has very many different ones are cut into single edges and dealt by these.
2. Walks: each document goes along repeated edges; while its next edge is also the next one in
   the source, both are one walk, an interval of the source's edges. Where a document goes on
   to an edge that is not the next one of the source, the node between branches.
3. Compaction: Spark joins walks with the branching nodes that they pass, which cuts them into
   nonbranching paths, named after the path of the source that they lie on.
4. Verification: each path's words are read in the source document at the recorded
   coordinates and digested (SHA-256); a document loses a span only if its own words there
   have the same digest.

Defined cases: null text has no words; documents of fewer than WINDOW words lose nothing;
rows of equal ids are no lesser document to each other, whether their texts are equal or not,
and each row only loses what itself shares with a lesser id; rows without an id come out whole
and remove nothing; a very long text is read in portions; an empty table gives no rows; other
columns may have any name and are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch, quoted
from driftmark.llm.repeats import WINDOW, Repeats, as_table, binary, crowded, dealt, distinct, filled, flat, home_column, pack_ids, single_windows, span_hashes, unfolded, unpack_ids, within, word_units
from driftmark.llm.rolling import windows

ANCHOR = 16
#: Edges of a source that one row of the join of walks and branching nodes covers.
STRETCH = 256

RUNS = "kind int, home int, part int, anchor bigint, edges binary, doc bigint, text bigint, start bigint, last bigint, piece int, pieces binary, texts binary, places binary"


def runs(repeats: Repeats) -> DataFrame:
    """kind 0: each home's distinct runs of edges; kind 1, packed: where they are in its texts."""
    parts = repeats.parts

    def look(home: int, ids: np.ndarray, texts: list[bytes], found: Callable) -> pa.Table:
        listed, edges = [], []
        for portion, owner, start, place, count, anchor, _ in found():
            listed.append((owner, place, count, anchor, span_hashes(portion, start, start + count + WINDOW - 1)))
            hashed = windows(portion, WINDOW).view(np.int64)
            edges += [hashed[a:b].tobytes() for a, b in zip(start.tolist(), (start + count).tolist(), strict=True)]
        if not listed:
            return as_table([], RUNS)
        owner, place, count, anchor, name = (np.concatenate(x) for x in zip(*listed, strict=True))
        order = np.lexsort((place, owner, count, name))
        owner, place, count, anchor, name = (x[order] for x in (owner, place, count, anchor, name))
        new = np.concatenate([[True], (name[1:] != name[:-1]) | (count[1:] != count[:-1])])
        first = np.flatnonzero(new)
        n = len(first)
        held = filled(
            RUNS, n, kind=np.zeros(n, np.int32), home=np.full(n, home, np.int32), part=((anchor[first] >> np.uint64(32)) % np.uint64(parts)).astype(np.int32),
            anchor=anchor[first].view(np.int64), edges=[edges[i] for i in order[first].tolist()], doc=ids[owner[first]], text=owner[first], start=place[first],
            last=ids[owner[np.append(first[1:] - 1, len(owner) - 1)]], piece=np.arange(n, dtype=np.int32),
        )
        where = filled(RUNS, 1, kind=[1], home=[home], pieces=[pack_ids(np.cumsum(new) - 1)], texts=[pack_ids(owner)], places=[pack_ids(place)])
        return pa.concat_tables([held, where])

    return repeats.candidates(look, RUNS)


def cut_up(repeats: Repeats, found: DataFrame) -> DataFrame:
    """The runs of crowded anchors as single edges, which have negative numbers at their home;
    kind 2, packed: which runs have them, and where."""
    parts = repeats.parts

    def divide(group: pa.Table) -> pa.Table:
        data, sizes = flat(group.column("edges"))
        edge = data.view(np.int64)
        owner, offset = np.repeat(np.arange(len(sizes)), sizes // 8), within(sizes // 8)
        doc, text, start, last, piece = (group.column(c).to_numpy().astype(np.int64) for c in ("doc", "text", "start", "last", "piece"))
        # of one document's equal edges the first in it, as for whole runs
        order = np.lexsort((start[owner] + offset, text[owner], doc[owner]))
        owner, offset, edge = owner[order], offset[order], edge[order]
        first, latest, number = single_windows(owner, edge.view(np.uint64), edge, doc, last)
        m, home = len(first), group.column("home")[0].as_py()
        own, name = owner[first], edge[first].view(np.uint64)
        held = filled(
            RUNS, m, kind=np.zeros(m, np.int32), home=np.full(m, home, np.int32), part=((name >> np.uint64(32)) % np.uint64(parts)).astype(np.int32), anchor=edge[first],
            edges=binary(edge[first].view(np.uint8).reshape(-1, 8)), doc=doc[own], text=text[own], start=start[own] + offset[first], last=latest, piece=-np.arange(1, m + 1, dtype=np.int32),
        )
        where = filled(RUNS, 1, kind=[2], home=[home], pieces=[pack_ids(piece[owner])], texts=[pack_ids(number)], places=[pack_ids(offset)])
        return pa.concat_tables([held, where])

    return repeats.spread(found, "home").groupBy("home").applyInArrow(divide, RUNS)


SEGMENTS = "home int, pieces binary, froms binary, tos binary, docs binary, rows binary, starts binary"


def sources(candidates: DataFrame, repeats: Repeats) -> DataFrame:
    """Stretches of the runs whose edges follow one another in a lesser document, packed by home:
    piece, first edge, last edge + 1; document, its text at its home, and the first edge there."""

    def name(group: pa.Table) -> pa.Table:
        data, sizes = flat(group.column("edges"))
        edge, n = data.view(np.int64), sizes // 8
        doc, text, start, last, home, piece = (group.column(c).to_numpy().astype(np.int64) for c in ("doc", "text", "start", "last", "home", "piece"))
        owner = np.repeat(np.arange(len(n)), n)
        offset = within(n)
        place = start[owner] + offset
        order = np.lexsort((place, text[owner], doc[owner], edge))
        heads = np.flatnonzero(np.concatenate([[True], edge[order][1:] != edge[order][:-1]]))
        source = np.empty(len(order), np.int64)
        source[order] = np.repeat(order[heads], np.diff(np.append(heads, len(order))))
        kept = np.flatnonzero(doc[owner[source]] < last[owner])
        if not len(kept):
            return as_table([], SEGMENTS)
        own, at, src = owner[kept], offset[kept], source[kept]
        follows = (own[1:] == own[:-1]) & (at[1:] == at[:-1] + 1) & (doc[owner[src]][1:] == doc[owner[src]][:-1]) & (text[owner[src]][1:] == text[owner[src]][:-1]) & (place[src][1:] == place[src][:-1] + 1)
        first = np.flatnonzero(np.concatenate([[True], ~follows]))
        end = at[np.append(first[1:] - 1, len(at) - 1)] + 1
        own, at, src = own[first], at[first], src[first]
        packed = [(h, *map(pack_ids, x)) for h, *x in dealt(home[own], piece[own], at, end, doc[owner[src]], text[owner[src]], place[src])]
        return as_table(packed, SEGMENTS)

    rows = candidates.select("part", "edges", "doc", "text", "start", "last", "home", "piece")
    return repeats.spread(rows, "part").groupBy("part").applyInArrow(name, SEGMENTS)


PLACED = ("texts", "places")
SOURCED = ("froms", "tos", "docs", "rows", "starts")


def walks_of(told: pa.Table) -> tuple[np.ndarray, ...]:
    """(text, start, end, source document, source text, source start) of all stretches of a
    home, from its packed places and segments, whether or not the text's id is above the source's."""
    kinds = told.column("kind").to_pylist()

    def column(name: str, kind: int) -> np.ndarray:
        return unpack_ids([x for x, k in zip(told.column(name).to_pylist(), kinds, strict=True) if k == kind])

    piece, text, place = (column(n, 1) for n in ("pieces", *PLACED))
    single = tuple(column(n, 2) for n in ("pieces", "places", "texts"))
    asked, first, last, doc, row, start = (column(n, 3) for n in ("pieces", *SOURCED))
    which, asked, first, last = unfolded(asked, first, last, single)
    doc, row, start = doc[which], row[which], start[which]
    order = np.argsort(piece, kind="stable")
    piece, text, place = piece[order], text[order], place[order]
    lo, hi = np.searchsorted(piece, asked, "left"), np.searchsorted(piece, asked, "right")
    which, at = np.repeat(np.arange(len(asked)), hi - lo), np.repeat(lo, hi - lo) + within(hi - lo)
    return text[at], place[at] + first[which], place[at] + last[which], doc[which], row[which], start[which]


def joined(ids: np.ndarray, told: pa.Table) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The walks of documents above their source, joined where both go on; and whether each walk
    goes on to another one, which its last node then branches to.

    ids: the id of each text of the home.
    """
    text, start, end, doc, row, at = walks_of(told)
    late = ids[text] > doc
    order = np.lexsort((start[late], text[late]))
    text, start, end, doc, row, at = (x[late][order] for x in (text, start, end, doc, row, at))
    touches = np.concatenate([(text[1:] == text[:-1]) & (start[1:] == end[:-1]), [False]]) if len(text) else np.empty(0, bool)
    goes_on = touches[:-1] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (at[1:] == at[:-1] + (end - start)[:-1])
    first = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(text) else np.empty(0, np.int64)
    final = np.append(first[1:] - 1, len(text) - 1) if len(text) else first
    return (text[first], start[first], end[final], doc[first], row[first], at[first]), touches[final]


WALKS = "kind int, home int, doc bigint, row bigint, start bigint, end bigint"


def walked(known: DataFrame, repeats: Repeats) -> DataFrame:
    """kind 0: each home's distinct walks, as intervals of the source's edges; kind 1: branching
    nodes, by the edge of the source before which they lie."""

    def walk(group: pa.Table) -> pa.Table:
        names = group.column("ids").to_pylist()
        ids = unpack_ids([x for x in names if x is not None])
        (text, start, end, doc, row, at), touches = joined(ids, group)
        if not len(text):
            return as_table([], WALKS)
        size = end - start
        home = group.column("home")[0].as_py()
        # both sides of a step that leaves the source: where it comes from and where it enters
        on = np.flatnonzero(touches)
        nodes = np.concatenate([np.stack([doc[on], row[on], at[on] + size[on]]), np.stack([doc[on + 1], row[on + 1], at[on + 1]])], axis=1) if len(on) else np.empty((3, 0), np.int64)
        intervals = np.unique(np.stack([doc, row, at, at + size]), axis=1)
        nodes = np.unique(nodes, axis=1)
        n, m = intervals.shape[1], nodes.shape[1]
        one = filled(WALKS, n, kind=np.zeros(n, np.int32), home=np.full(n, home, np.int32), doc=intervals[0], row=intervals[1], start=intervals[2], end=intervals[3])
        other = filled(WALKS, m, kind=np.ones(m, np.int32), home=np.full(m, home, np.int32), doc=nodes[0], row=nodes[1], start=nodes[2], end=nodes[2])
        return pa.concat_tables([one, other])

    return repeats.spread(known, "home").groupBy("home").applyInArrow(walk, WALKS)


def compacted(walks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, row, start, end, from, to, path): each distinct walk cut at the branching nodes that
    it passes; path: the first edge of the nonbranching path of the source that a part lies on.

    walks: (doc, row, start, end), nodes: (doc, row, at).
    """
    walk = ["doc", "row", "start", "end"]
    distinct_walks = walks.select(*walk).distinct()
    stretch: Column = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor(F.col("end") / STRETCH)))
    here = distinct_walks.select(*walk, stretch.alias("stretch"))
    there = nodes.select("doc", "row", "at").distinct().withColumn("stretch", F.floor(F.col("at") / STRETCH))
    passed = here.join(there, ["doc", "row", "stretch"]).filter((F.col("at") > F.col("start")) & (F.col("at") < F.col("end")))
    cuts = passed.select(*walk, F.col("at").alias("from")).unionByName(distinct_walks.withColumn("from", F.col("start")))
    along = Window.partitionBy(*walk).orderBy("from")
    parts = cuts.withColumn("to", F.coalesce(F.lead("from").over(along), F.col("end")))
    # parts of one path of the source: those that overlap or go on where nothing branches
    distinct_parts = parts.select("doc", "row", "from", "to").distinct()
    branches = there.select("doc", "row", F.col("at").alias("from"), F.lit(True).alias("branch"))
    marked = distinct_parts.join(branches, ["doc", "row", "from"], "left")
    read = Window.partitionBy("doc", "row").orderBy("from", "to")
    before = F.max("to").over(read.rowsBetween(Window.unboundedPreceding, -1))
    heads = marked.withColumn("head", F.when(before.isNull() | (F.col("from") > before) | (F.col("branch") & (F.col("from") == before)), F.col("from")))
    named = heads.withColumn("path", F.last("head", ignorenulls=True).over(read)).select("doc", "row", "from", "to", "path")
    return parts.join(named, ["doc", "row", "from", "to"])


DIGESTS = "doc bigint, row bigint, from bigint, to bigint, digest binary"


def digested(words: list[bytes], start: int, end: int) -> bytes:
    return hashlib.sha256(b" ".join(words[start:end])).digest()


def read_sources(repeats: Repeats, parts: DataFrame) -> DataFrame:
    """The digest of the words of each part of a path, read in the source's text: doc, row, from, to, digest."""

    def visit(docs: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return as_table([], DIGESTS)
        _, texts, _ = distinct(docs)
        doc, row, start, end = (asked.column(c).to_numpy() for c in ("doc", "row", "from", "to"))
        out, order = [], np.argsort(row, kind="stable").tolist()
        words, held = [], -1
        for i in order:
            if row[i] != held:
                words, held = texts[row[i]].split(), row[i]  # ASCII white space
            out.append((int(doc[i]), int(row[i]), int(start[i]), int(end[i]), digested(words, int(start[i]), int(end[i]) + WINDOW - 1)))
        return as_table(out, DIGESTS)

    asked = parts.select("doc", "row", "from", "to").distinct().withColumn("home", home_column(F.col("doc"), repeats.homes))
    return repeats.with_texts(asked, visit, DIGESTS)


#: kind 1: places, 2: runs that were cut up, 3: segments, 4: ids, 5: parts of paths.
EMPTY = {"ids": "binary", "pieces": "binary", **dict.fromkeys((*PLACED, *SOURCED), "binary"), **dict.fromkeys(("doc", "row", "start", "end", "from", "to"), "bigint"), "digest": "binary"}


def _padded(df: DataFrame, kind: int | None = None) -> DataFrame:
    """Under all the columns that a home's findings may have."""
    return df.select("home", F.col("kind") if kind is None else F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in EMPTY.items()])


IDS = "home int, ids binary"


def ids_of(repeats: Repeats) -> DataFrame:
    """The id of each distinct text of a home, in order, packed."""
    slim = repeats.at_home().select("home", "doc", F.xxhash64("text").alias("hash")).distinct()

    def pack(group: pa.Table) -> pa.Table:
        return as_table([(group.column("home")[0].as_py(), pack_ids(np.sort(group.column("doc").to_numpy())))], IDS)

    return repeats.spread(slim, "home").groupBy("home").applyInArrow(pack, IDS)


def repeated_paths(repeats: Repeats, scratch: Scratch) -> DataFrame:
    """All that is known at each home: where its runs are, their sources, and for its walks the
    parts of compacted paths with the digests of the source's words."""
    found = scratch.write(runs(repeats))
    candidates, places = found.filter("kind = 0"), found.filter("kind = 1")
    if (anchors := crowded(found, "anchor")) is not None:
        divided = scratch.write(cut_up(repeats, candidates.join(F.broadcast(anchors), "anchor", "left_semi")))
        candidates = candidates.join(F.broadcast(anchors), "anchor", "left_anti").unionByName(divided.filter("kind = 0"))
        places = places.unionByName(divided.filter("kind = 2"))
    segments = scratch.write(sources(candidates, repeats))
    known = _padded(places.select("home", "kind", "pieces", *PLACED)).unionByName(_padded(segments, 3))
    walks = scratch.write(walked(known.unionByName(_padded(ids_of(repeats), 4)), repeats))
    steps, nodes = walks.filter("kind = 0"), walks.filter("kind = 1").select("doc", "row", F.col("start").alias("at"))
    parts = scratch.write(compacted(steps, nodes))
    digests = scratch.write(read_sources(repeats, parts))
    told = steps.select("home", "doc", "row", "start", "end").join(parts.drop("path"), ["doc", "row", "start", "end"]).join(digests, ["doc", "row", "from", "to"])
    return known.unionByName(_padded(scratch.write(told), 5))


def verified(ids: np.ndarray, texts: list[bytes], told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the parts of walks whose words have the digest of the source's."""
    paths: dict[tuple, list[tuple]] = {}
    numbers = [told.column(c).to_pylist() for c in ("doc", "row", "start", "end", "from", "to", "digest")]
    for doc, row, start, end, at, to, digest in zip(*numbers, strict=True):
        if digest is not None:
            paths.setdefault((doc, row, start, end), []).append((at, to, digest))
    (text, start, end, doc, row, at), _ = joined(ids, told)
    out, words, held = [], [], -1
    for t, s, e, *source in zip(*[x.tolist() for x in (text, start, end, doc, row, at)], strict=True):
        if t != held:
            words, held = texts[t].split(), t
        for begin, to, digest in paths.get((*source, source[2] + e - s), ()):
            a, b = s + begin - source[2], s + to - source[2] + WINDOW - 1
            if digested(words, a, b) == digest:
                out.append((t, a, b))
    return tuple(np.array([x[i] for x in out], np.int64) for i in range(3))


def kept_words(text: bytes, spans: np.ndarray) -> tuple[int, list[bytes]]:
    """How many words a text has, and those outside the spans."""
    words = text.split()  # ASCII white space
    kept, at = [], 0
    for start, end in spans.tolist():
        kept += words[at:start]
        at = end
    return len(words), kept + words[at:]


RESULT = "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def remove_passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256; a row for each row."""
    scratch = Scratch(df.sparkSession)
    repeats = Repeats(df.select(quoted(key).alias("key"), quoted(text).alias("text")), word_units, ANCHOR)

    def report(doc: int | None, text: bytes, removed: np.ndarray) -> tuple:
        n, kept = kept_words(text, removed)
        return doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return repeats.finished(repeated_paths(repeats, scratch), verified, report, RESULT).withColumnRenamed("doc", key)
