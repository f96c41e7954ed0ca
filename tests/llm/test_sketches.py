import hashlib
import random

import numpy as np
import pytest

from driftmark.llm import fracsketch as S


def literal(text, scale=S.SCALE):
    """The sketch, from the definition: a polynomial of each shingle's bytes, scrambled, of which the top bits count."""
    data, mask = text.encode(), (1 << 64) - 1
    size = min(S.SHINGLE, len(data))
    seed = len(data) if len(data) < S.SHINGLE else 0
    found = set()
    for start in range(len(data) - size + 1 if data else 0):
        value = 0
        for byte in data[start : start + size]:
            value = (value * 0x9E3779B97F4A7C15 + byte + 1 + seed) & mask
        value ^= value >> 33
        value = value * 0xFF51AFD7ED558CCD & mask
        value ^= value >> 29
        value = value * 0xC4CEB9FE1A85EC53 & mask
        value ^= value >> 32
        found.add(value >> 64 - S.HASH_BITS)
    low = sorted(h for h in found if h < (1 << S.HASH_BITS) // scale)
    return low or sorted(found)[:1]


def alike(one, other):
    """Likeness from the definition."""
    if one == other:
        return 1.0
    least = min(len(one), len(other))
    return len(set(one) & set(other)) / least if least else 0.0


@pytest.mark.parametrize("scale", [1, 8, 64])
def test_sketches_from_the_definition(corpus, scale, monkeypatch):
    monkeypatch.setattr(S, "PORTION", 100)
    for text in {t or "" for _, t in corpus}:
        got = S.sketch(text, scale)
        assert got[0] == scale and got[1].tolist() == literal(text, scale)
        back = S.read(S.written(got))
        assert back[0] == scale and np.array_equal(back[1], got[1])


def test_one_fraction_at_every_length():
    rng = random.Random(4)
    for size in (2000, 60_000, 2_000_000):
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=size))
        assert len(S.sketch(text)[1]) == pytest.approx(size / S.SCALE, rel=0.2)


def test_merging_is_the_union(corpus):
    rng = random.Random(1)
    texts = [t for _, t in corpus if t]
    for _ in range(40):
        a, b = rng.sample(texts, 2)
        both = sorted({*literal(a), *literal(b)})
        low = [h for h in both if h < (1 << S.HASH_BITS) // S.SCALE]
        assert S.merged(S.sketch(a), S.sketch(b))[1].tolist() == (low or both[:1])
        assert S.at_scale(S.sketch(a), 64).tolist() == literal(a, 64) == S.at_scale(S.sketch(a, 8), 64).tolist()
    assert S.union([]) [1].tolist() == [] and S.union([S.sketch(t) for t in texts[:5]])[0] == S.SCALE


def test_containment_of_very_unequal_texts():
    rng = random.Random(2)
    words = [f"{rng.getrandbits(40):x}" for _ in range(6000)]
    long, part = " ".join(words), " ".join(words[1000:1600])
    assert S.containment(S.sketch(part), S.sketch(long)) == pytest.approx(1, abs=0.02)
    assert S.containment(S.sketch(long), S.sketch(part)) == pytest.approx(0.1, abs=0.05)
    assert S.likeness(S.sketch("fresh " * 3), S.sketch(long)) == 0


def test_edits_and_neighbours_by_brute_force(spark, documents, corpus):
    got = {r.doc_id: r for r in S.compare_edits(documents.selectExpr("doc_id", "text", "1 AS part", "2 AS ahead")).collect()}
    rows = sorted((i, t or "") for i, t in corpus)
    assert len(got) == len(rows)
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        edited, r = S.edited(text, following), got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(S.written((S.SCALE, np.array(literal(x), np.uint64))) for x in (text, edited))
        assert r.near_edited == alike(literal(text), literal(edited)) and 0 <= r.near_edited <= 1
        assert r.near_next == alike(literal(text), literal(following))


def test_ties_nulls_and_few_rows(spark):
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (None, "z"), (None, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in S.compare_edits(rows).collect())
    assert got == [(False, 0, 0), (False, 0, 1), (True, 1, 1), (True, 1, 1), (True, 1, 1)]
    one = S.compare_edits(rows.filter("doc_id IS NULL AND text = 'z'")).first()
    assert one.near_next == 1 and one.near_edited == 1
    assert S.compare_edits(rows.limit(0)).count() == 0
