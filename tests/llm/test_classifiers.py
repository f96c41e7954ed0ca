import random
import zlib

import pytest

from driftmark.llm import compression_classifier as C
from driftmark.llm import factorization as M
from driftmark.llm.labelled import sample
from tests.llm.conftest import prose


def noise(rng):
    return " ".join("".join(rng.choice("#%&$*") for _ in range(3)) + w for w in prose(rng, rng.randint(5, 60)).split())


def test_compression_tells_noise_from_prose():
    rng = random.Random(1)
    train = [(prose(rng, rng.randint(5, 200)), 1) for _ in range(300)] + [(noise(rng), 0) for _ in range(200)]
    score = C.train(train).scorer()
    good = score([prose(rng, rng.randint(5, 200)) for _ in range(100)])
    bad = score([noise(rng) for _ in range(100)])
    assert (good >= 0.5).mean() > 0.97 and (bad < 0.5).mean() > 0.97
    assert 0 <= score([""])[0] <= 1


def test_machine_learns_a_pairwise_interaction():
    """Toxic only where both words meet, which no additive model can learn."""
    rng = random.Random(2)

    def text():
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = prose(rng, 20).split() + ["insult"] * insult + ["group"] * group
        rng.shuffle(words)
        return " ".join(words), int(insult and group)

    model = M.train([text() for _ in range(1500)])
    held = [text() for _ in range(400)]
    assert sum((model.score(t) >= 0.5) == bool(y) for t, y in held) / 400 > 0.97


def test_one_class_or_no_label_gives_one_half():
    assert C.train([("a", 1)]).scorer()(["x", ""]).tolist() == [0.5, 0.5]
    assert C.train([]).scorer()([]).tolist() == []
    assert M.train([("a", 0)]).score("x") == M.train([]).score("") == 0.5


def test_tables_are_scored_row_by_row(spark, documents, corpus):
    rng = random.Random(3)
    examples = [(prose(rng, 30), 1) for _ in range(40)] + [(noise(rng), 0) for _ in range(40)]
    rows = documents.selectExpr("doc_id", "text", "1 AS score", "'a' AS lang")
    for scored in (C.score_quality(rows, C.train(examples)), M.score_toxicity(rows, M.train(examples))):
        got = {r.doc_id: r.score for r in scored.collect()}
        assert len(got) == len(corpus) and all(0 <= s <= 1 for s in got.values())
    assert C.score_quality(rows.limit(0), C.train(examples)).count() == 0


@pytest.mark.parametrize("per_class", [3, 1000])
def test_sample_is_bounded_and_leaves_the_fold_out(spark, per_class):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "n")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (4, None)], "doc_id bigint, quality int")
    got = sample(docs, labels, "quality", per_class)
    ids = [int(t.split()[1]) for t, _ in got]
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids) and all(label == i % 2 for i, (_, label) in zip(ids, got, strict=True))
    assert len(got) == (6 if per_class == 3 else sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200)))
    assert got == sample(docs.repartition(7), labels.repartition(3), "quality", per_class)
    assert sample(docs, labels.limit(0), "quality", 5) == []


def test_compression_judges_a_long_text_by_all_of_it():
    rng = random.Random(4)
    words = {v: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 9))) for _ in range(1500)] for v in (0, 1)}

    def text(v, size):
        return " ".join(rng.choices(words[v], k=size // 5))[:size]

    model = C.train([(text(v, rng.randint(300, 3000)), v) for v in (0, 1) for _ in range(300)])
    score = model.scorer()
    mixed = [text(1, 64 << 10) + " " + text(0, 1 << 20), text(0, 64 << 10) + " " + text(1, 1 << 20)]
    assert score(mixed)[0] < 0.5 < score(mixed)[1]
    sizes = C.Sizes(model.good, model.bad)
    assert all(abs(sizes.features(text(v, 1 << 20).encode())[0]) > 0.5 * abs(sizes.features(text(v, 4096).encode())[0]) for v in (0, 1))


def test_dictionaries_take_pieces_from_the_whole_text():
    long = b"".join(b"%07d " % i for i in range(5000))
    got = C.pieces(long)
    assert got[0] == long[: len(got[0])] and got[-1] == long[-len(got[-1]) :] and sum(map(len, got)) == C.TEXT_SHARE
    assert C.pieces(b"short") == [b"short"] and C.pieces(b"") == []


def test_sample_takes_whole_texts_within_its_bytes(spark):
    docs = spark.createDataFrame([(i, ("é" if i % 2 else "z") * 100 * (1 + i)) for i in range(20)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    whole = {t for _, t in docs.collect()}
    got = sample(docs, labels, "quality", 9, most_bytes=3000)
    assert got and all(t in whole for t, _ in got)
    assert all(0 < sum(len(t.encode()) for t, v in got if v == label) <= 3000 for label in (0, 1))
    assert len(sample(docs, labels, "quality", 9, most_bytes=1 << 20)) > len(got)


def _pair_texts(toxic, insult, mention, n=4000, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rng.random() < insult, rng.random() < mention
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(10, 60))] + ["insultt"] * a + ["groupx"] * b
        rng.shuffle(words)
        out.append((" ".join(words), int(toxic(a, b))))
    return out


@pytest.mark.parametrize(
    ("toxic", "insult", "mention"),
    [(lambda a, b: a != b, 0.5, 0.5), (lambda a, b: a and b, 0.5, 0.85), (lambda a, b: a and b, 0.3, 0.6), (lambda a, b: a and not b, 0.5, 0.8)],
)
def test_factorization_learns_pairs_that_single_terms_do_not_tell(toxic, insult, mention):
    texts = _pair_texts(toxic, insult, mention)
    model = M.train(texts[:3000])
    assert sum((model.score(t) >= 0.5) == bool(y) for t, y in texts[3000:]) / 1000 > 0.95


def _held_out(name, label):
    import duckdb

    at = "/root/testdata/sf0.1"
    rows = duckdb.sql(f"SELECT d.doc_id, d.text, l.{label} FROM '{at}/documents.parquet' d JOIN '{at}/labels.parquet' l USING (doc_id) ORDER BY 1").fetchall()
    known, unseen = ([r for r in rows if (zlib.crc32(str(r[0]).encode()) % 5 == 0) == fold] for fold in (False, True))
    return [(t, y) for _, t, y in known], [t for _, t, _ in unseen], [y for _, _, y in unseen]


def _ranking(scores, labels):
    """The share of pairs of a good and a bad row that are ranked right."""
    good, bad = ([s for s, y in zip(scores, labels, strict=True) if y == v] for v in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_the_held_out_fold():
    known, texts, labels = _held_out("documents", "quality")
    model = C.train(known)
    scores = list(model.scorer()(texts))
    assert _ranking(scores, labels) > 0.985
    sizes = C.Sizes(model.good, model.bad)
    assert _ranking([sizes.features(t.encode())[0] for t in texts], labels) > 0.985  # the difference alone
    assert sum(s >= 0.3 for s, y in zip(scores, labels, strict=True) if y) / sum(labels) > 0.99


def test_toxicity_on_the_held_out_fold():
    known, texts, labels = _held_out("documents", "toxic")
    model = M.train(known)
    scores = [model.score(t) for t in texts]
    assert _ranking(scores, labels) > 0.985
    assert sum(s >= 0.5 for s, y in zip(scores, labels, strict=True) if y) / sum(labels) >= 0.9
    assert sum(s >= 0.5 for s, y in zip(scores, labels, strict=True) if not y) / labels.count(0) < 0.01
