import random

from driftmark.llm import decontaminate as D
from driftmark.llm.decontaminate import contamination, proximity


def words(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def brute(docs, items, size=13):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, item_text in items:
            t = words(item_text)
            n = min(size, len(t))
            for s in range(len(t) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == t[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out.append((key, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_by_brute_force(spark):
    rng = random.Random(6)
    vocabulary = ["the", "of", "É", "naïve", "x1"] + [f"w{i}" for i in range(30)]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", "-", "\n"]) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 2, 5, 12, 13, 14, 30]))) for i in range(25)] + [(99, None), (3, "the THE the"), (98, "the " * 20)]
    docs = [(i, text(rng.randint(0, 120))) for i in range(60)] + [(200, None), (201, ""), (5, "again " + items[7][1]), (202, "the " * 50)]
    for i in range(60, 90):
        item = rng.choice(items)[1] or ""
        docs.append((i, text(rng.randint(0, 60)) + item.upper() + " " + text(rng.randint(0, 60)) + item))
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 AS words", "2 AS line", "3 AS low").repartition(4)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(rows, bench).collect()], key=str)
    assert got == brute(docs, items)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_BYTES", -1)
    test_by_brute_force(spark)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert sorted(r.n_hit for r in contamination(docs, items.limit(0)).collect()) == [0, 0]
    assert contamination(docs.limit(0), items).count() == 0


def test_proximity_allows_a_gap(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    near = item.replace("zeta", "and zeta")
    far = item.replace("zeta", "one two three four five six zeta")
    docs = spark.createDataFrame([(1, "start " + near + " end"), (2, far), (3, item), (4, "nothing of it")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = {r.doc_id: r.near for r in proximity(docs, items, slack=2).collect()}
    assert got == {1: [7], 2: [], 3: [7], 4: []}
    exact = {r.doc_id: r.n_hit for r in contamination(docs, items).collect()}
    assert exact == {1: 0, 2: 0, 3: 13, 4: 0}


def test_proximity_by_brute_force_over_shifts(spark):
    rng = random.Random(6)
    terms = "alpha beta gamma delta epsilon zeta eta theta".split()
    docs = []
    for shift in range(12):
        for gap in range(0, 10):
            at = rng.randint(1, 7)
            docs.append((len(docs), " ".join(["pad"] * shift + terms[:at] + ["gap"] * gap + terms[at:] + ["end"] * (shift % 3))))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(terms))], "item_id bigint, text string")
    for slack in (1, 2, 4):
        got = {r.doc_id: r.near for r in proximity(frame, items, slack=slack, window=6).collect()}
        for key, text in docs:
            w, n = text.split(), 6 + 2 * slack
            found = any(set(terms[s : s + 6]) <= set(w[p : p + n]) for s in range(3) for p in range(len(w)))
            assert got[key] == ([7] if found else []), (slack, text)


def test_clean_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, None), (2, "q r s", 6, "t")], "doc_id bigint, text string, key int, row string")
    items = spark.createDataFrame([(7, "a b c")], "item_id bigint, text string")
    got = D.clean(docs, items)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [(2, "q r s", 6, "t")]


def test_clean_lets_no_window_through(spark):
    """A window in a long text is under a twentieth of its words, and still a benchmark passage."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(10)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 60, 900])))) for i in range(40)]
    for i in range(40, 60):
        words_ = rng.choice(items)[1].split()
        at = rng.randrange(8)
        passage = words_[at : at + (13 if i % 2 else 12)]  # a whole window, or a word less
        docs.append((i, " ".join(rng.choices(vocabulary, k=500) + passage + rng.choices(vocabulary, k=500))))
    told = brute(docs, items)
    hit = {key for key, _, n, _, _ in told if n}
    assert any(n and not dirty for _, _, n, _, dirty in told) and 8 <= len(hit) <= 12
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = D.clean(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert {r.doc_id for r in got.collect()} == {i for i, _ in docs} - hit


def test_rows_that_share_an_id_and_a_repetitive_text(spark):
    item = "a b c d e f g h i j k l m n"
    rows = [(1, item), (1, "clean"), (1, item), (None, item + " x"), (None, None), (2, "a b " * 3000), (3, (item + " ") * 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = [(7, item), (8, "a b " * 40)]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()), key=str)
    assert got == brute(rows, items)
