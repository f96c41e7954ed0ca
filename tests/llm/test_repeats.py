import hashlib
import random
import re

import numpy as np
import pytest

from driftmark.llm import debruijn, repeats, rolling, suffix_levels


def covered(units, seen):
    """Mask of the units in windows that were seen, and the windows of its own."""
    mask, own = [False] * len(units), []
    for i in range(len(units) - 49):
        window = units[i : i + 50]
        if window in seen:
            mask[i : i + 50] = [True] * 50
        own.append(window)
    return mask, own


def brute(rows, split):
    """(id, units, mask) in ascending order; rows of equal ids don't see each other."""
    out, seen = [], set()
    ordered = sorted((i, t or "") for i, t in rows)
    for n, (i, text) in enumerate(ordered):
        if n and ordered[n - 1][0] != i:
            seen.update(w for _, _, _, own, j in out if j < n for w in own)
        units = split(text)
        mask, own = covered(units, seen)
        out.append((i, units, mask, own, n))
    return [(i, units, mask) for i, units, mask, _, _ in out]


@pytest.fixture(params=[1 << 18, 700])
def portion(request, monkeypatch):
    monkeypatch.setattr(repeats, "PORTION", request.param)
    monkeypatch.setattr(repeats, "GATHERED", request.param)
    monkeypatch.setattr(repeats, "HOME_BYTES", 20 * request.param)
    if request.param == 700:  # every anchor with two surroundings is cut into single windows
        monkeypatch.setattr(repeats, "CROWD", 1)
    return request.param


def test_bytes_by_brute_force(documents, corpus, portion):
    got = {r.doc_id: tuple(r)[1:] for r in suffix_levels.remove_repeats(documents.selectExpr("doc_id", "text", "1 AS home", "2 AS doc")).collect()}
    assert len(got) == len(corpus)
    for i, data, mask in brute(corpus, lambda t: t.encode()):
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        spans = sum(m and (n == 0 or not mask[n - 1]) for n, m in enumerate(mask))
        assert got[i] == (len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    assert sum(r[1] for r in got.values()) > 5000


def test_words_by_brute_force(documents, corpus, portion):
    got = {r.doc_id: tuple(r)[1:] for r in debruijn.remove_passages(documents.selectExpr("doc_id", "text", "1 AS anchor", "2 AS piece")).collect()}
    assert len(got) == len(corpus)
    for i, words, mask in brute(corpus, lambda t: tuple(re.findall("[^\x20\x09-\x0d]+", t))):
        kept = " ".join(w for w, m in zip(words, mask, strict=True) if not m)
        assert got[i] == (len(words), sum(mask), hashlib.sha256(kept.encode()).hexdigest())
    assert sum(r[1] for r in got.values()) > 1000


@pytest.mark.parametrize("remove", [suffix_levels.remove_repeats, debruijn.remove_passages])
def test_repeated_rows_null_ids_and_no_rows(spark, remove):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(3, text), (3, text), (None, text), (None, None), (9, text), (1, "short")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in remove(rows).collect())
    whole = 60 if remove is debruijn.remove_passages else len(text)
    assert got == [("1", 0), ("3", 0), ("3", 0), ("9", whole), ("None", 0), ("None", 0)]
    assert remove(rows.limit(0)).count() == 0


@pytest.mark.parametrize("remove", [suffix_levels.remove_repeats, debruijn.remove_passages])
def test_rows_that_share_an_id_keep_what_is_theirs(spark, remove):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(80)) for x in "xyz")
    rows = [(1, a), (5, a), (5, b), (5, a), (7, b + " " + c), (7, c), (8, c + " end")]
    split = (lambda t: t.encode()) if remove is suffix_levels.remove_repeats else (lambda t: tuple(t.split()))
    got = sorted((r[0], r[1], r.n_removed) for r in remove(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted((i, len(units), sum(mask)) for i, units, mask in brute(rows, split))
    assert (5, len(split(b)), 0) in got


def test_nothing_is_removed_without_the_levels(spark, documents, monkeypatch):
    monkeypatch.setattr(suffix_levels.SuffixLevels, "add", lambda self, batch, last=False: batch.limit(0).selectExpr("home", *(f"CAST(NULL AS binary) AS {n}" for n in ("pieces", "starts", "ends", "least"))))
    assert suffix_levels.remove_repeats(documents).selectExpr("sum(n_removed)").first()[0] == 0


def test_nothing_is_removed_without_compaction(spark, documents, monkeypatch):
    whole = debruijn.compacted
    monkeypatch.setattr(debruijn, "compacted", lambda walks, nodes: whole(walks, nodes).limit(0))
    assert debruijn.remove_passages(documents).selectExpr("sum(n_removed)").first()[0] == 0


def test_a_span_needs_the_source_words(documents, monkeypatch):
    read = debruijn.read_sources
    monkeypatch.setattr(debruijn, "read_sources", lambda repeats, parts: read(repeats, parts).selectExpr("doc", "row", "from", "to", "unhex(sha2(digest, 256)) AS digest"))
    assert debruijn.remove_passages(documents).selectExpr("sum(n_removed)").first()[0] == 0


def test_paths_are_cut_where_they_branch(spark):
    walks = spark.createDataFrame([(1, 0, 10, 60), (1, 0, 30, 90), (1, 0, 30, 90), (2, 3, 5, 6), (1, 0, 90, 700), (1, 0, 900, 901)], "doc bigint, row bigint, start bigint, end bigint")
    nodes = spark.createDataFrame([(1, 0, 40), (1, 0, 10), (1, 0, 90), (1, 0, 600), (2, 0, 5), (1, 0, 40)], "doc bigint, row bigint, at bigint")
    got = sorted(tuple(r)[:7] for r in debruijn.compacted(walks, nodes).select("doc", "row", "start", "end", "from", "to", "path").collect())
    assert got == [
        (1, 0, 10, 60, 10, 40, 10), (1, 0, 10, 60, 40, 60, 40), (1, 0, 30, 90, 30, 40, 10), (1, 0, 30, 90, 40, 90, 40),
        (1, 0, 90, 700, 90, 600, 90), (1, 0, 90, 700, 600, 700, 600), (1, 0, 900, 901, 900, 901, 900), (2, 3, 5, 6, 5, 6, 5),
    ]


def test_levels_merge_and_find(spark, tmp_path):
    """Batches of suffixes against a literal family, and the sizes of its levels."""
    from driftmark.llm.common import Scratch

    rng = random.Random(4)
    pool = [bytes(rng.choice(b"ab\0\xff") for _ in range(30)) for _ in range(4)]
    anchor = b"anchor of 20 bytes.."
    family = suffix_levels.SuffixLevels(Scratch(spark), lambda df, by: df)
    seen, doc = {}, 0
    for number in range(8):
        rows, expected = [], {}
        for piece in range(12):
            doc += rng.randint(0, 2)
            left, right = rng.choice(pool)[: rng.choice([0, 5, 30])], rng.choice(pool)
            text = left + anchor + right
            start, count = np.array([0]), np.array([len(text) - 49]) if len(text) >= 50 else np.array([1])
            record = suffix_levels.records(np.frombuffer(text, np.uint8), start, count, np.array([len(left)]))[0].tobytes()
            rows.append((piece % 2, 77 + piece % 2, record, doc, doc + 1, 3, piece))
            for i in range(int(count[0])):
                expected.setdefault((piece, i), (text[i : i + 50], piece % 2, doc))
        for window, part, d in expected.values():
            seen[part, window] = min(seen.get((part, window), d), d)
        batch = spark.createDataFrame(rows, "part int, key bigint, record binary, doc bigint, last bigint, home int, piece int")
        got = {}
        for r in family.add(batch).collect():
            for p, a, b, least in zip(*(repeats.unpack_ids([r[c]]).tolist() for c in ("pieces", "starts", "ends", "least")), strict=True):
                got.update({(p, i): least for i in range(a, b)})
        assert got == {k: seen[part, window] for k, (window, part, _) in expected.items()}
        assert [n for n, _ in family.levels] == [1 << i for i in range(3, -1, -1) if (number + 1) >> i & 1]
        for _, table in family.levels:
            for part in (0, 1):
                records = [bytes(r.record) for r in table.filter(f"part = {part}").collect()]
                assert records == sorted(set(records)) and records


def test_window_hashes_and_minima():
    rng = np.random.default_rng(1)
    units = rng.integers(0, 3, 300).astype(np.uint8)
    for k in (1, 2, 7, 20, 50):
        hashes = rolling.windows(units, k)
        by_content = {}
        for i, h in enumerate(hashes.tolist()):
            assert by_content.setdefault(units[i : i + k].tobytes(), h) == h
        assert len(set(by_content.values())) == len(by_content)
        assert rolling.window_minima(hashes, 13).tolist() == [min(hashes[i : i + 13].tolist()) for i in range(len(hashes) - 12)]


def test_words_are_hashed_alike_wherever_they_stand():
    a, b = repeats.word_units([b"one two  three", b"\tthree\none \x0btwo one"])
    assert (a[0], a[1], a[2]) == (b[1], b[2], b[0]) and b[3] == a[0] and len({*a.tolist()}) == 3
    assert [len(x) for x in repeats.word_units([b"", b"  ", b"x"])] == [0, 0, 1]


def test_united_spans():
    got = repeats.united(np.array([0, 2, 5, 9, 20]), np.array([4, 5, 6, 12, 21]))
    assert got.tolist() == [[0, 6], [9, 12], [20, 21]]
