import random

import pytest

SYLLABLES = "an be cor dü el fa gon hé is jo ka lu mi ño op ra se tor un va".split()


def prose(rng: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.08:
            out[-1] += rng.choice([".\n", ",", "  ", "\t"])
    return " ".join(out)


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, repetition, empty and null texts."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 260)) for _ in range(60)]
    passage, line = prose(rng, 75), prose(rng, 9)
    texts = list(base)
    texts += [base[3]] * 5 + [base[7] + " " + prose(rng, 3)] * 2
    for i in range(25):
        texts.append(prose(rng, rng.randint(0, 40)) + " " + passage + " " + prose(rng, rng.randint(0, 40)))
        texts.append(line + "\n" + prose(rng, rng.randint(0, 90)))
    for i in range(8):
        words = base[12].split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += ["", " \n ", "a", "da " * 700, "da " * 400 + "x", "é" * 300, "é" * 90 + "y", passage[:200], None, None]
    ids = rng.sample(range(-50, 4000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(5)
