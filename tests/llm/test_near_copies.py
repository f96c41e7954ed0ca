import random

import numpy as np
import pytest
import xxhash

from driftmark.llm import components, simhash
from driftmark.llm.common import Scratch


def least_reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def literal_fingerprint(text: str) -> int:
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_literally(corpus, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 50)
    for text in [t or "" for _, t in corpus] + ["ÀB c\x0bd\x85e", "one two"]:
        assert simhash.simhash(text) == literal_fingerprint(text)


def test_linked_fingerprints_meet_at_a_home():
    rng = random.Random(1)
    a = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    b = np.array([int(x) ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 4))) for x in a], np.uint64)
    for x, y in ((a, b), (b, a)):
        home, own, _, _ = simhash.anchors(x)
        _, _, reach, others = simhash.anchors(y)
        homes, reaches = set(zip(own.tolist(), home.tolist(), strict=True)), set(zip(others.tolist(), reach.tolist(), strict=True))
        assert {i for i, _ in homes & reaches} == set(range(300))


def test_forest_joins_the_same_nodes():
    rng = random.Random(2)
    for _ in range(50):
        links = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randint(0, 60))]
        a, b = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
        got = list(zip(*[x.tolist() for x in components.forest(a, b)], strict=True))
        nodes = range(40)
        assert least_reachable(nodes, links) == least_reachable(nodes, got)
        assert len(got) == len({n for n in nodes if least_reachable(nodes, links)[n] != n})


def test_roots_in_spark(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(200, 300)]
    other = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(7, 7), (1, 2), (1, 2)]
    links = chain + hub + other
    rng.shuffle(links)
    got = {r.node: r.root for r in components.roots(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark)).collect()}
    expected = least_reachable({n for link in links for n in link}, links)
    assert got == {n: r for n, r in expected.items() if n != r}
    assert components.roots(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark)).count() == 0


@pytest.mark.parametrize("hot", [100_000, 4])
def test_components_by_brute_force(spark, documents, corpus, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "SLICE", 3)
    monkeypatch.setattr(simhash, "HOT_COPIES", 2)
    rows = documents.unionByName(documents.filter("doc_id % 7 = 0")).selectExpr("doc_id", "text", "doc_id AS fp", "1 AS component_id")
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(rows.select("doc_id", "text")).collect()]
    assert len(got) == len(corpus) + sum(i % 7 == 0 for i, _ in corpus)
    prints = {i: literal_fingerprint(t or "") for i, t in corpus}
    ids = sorted(prints)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    expected = least_reachable(ids, links)
    assert all(fp == prints[i] and c == expected[i] for i, fp, c in got)


def test_null_ids_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "other words in here")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.component)) for r in simhash.near_duplicates(rows).collect())
    assert got == [("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0
