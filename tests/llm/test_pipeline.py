import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftmark.llm import compression_classifier as C
from driftmark.llm import queries, secrets, sql
from driftmark.llm.labelled import sample
from tests.llm.conftest import prose
from tests.llm.test_classifiers import noise
from tests.llm.test_decontaminate import brute
from tests.llm.test_near_copies import least_reachable, literal_fingerprint

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with junk, copies, benchmark passages and secrets."""
    rng = random.Random(21)
    items = [(i, prose(rng, 20)) for i in range(5)] + [(7, None)]
    texts = [prose(rng, rng.randint(20, 90)) for _ in range(60)]
    texts += [noise(rng) for _ in range(30)] + texts[:6] + [t + " end" for t in texts[6:9]]
    texts += [items[i][1] + " " + prose(rng, 30) for i in range(4)]
    texts.append(prose(rng, 600) + " " + items[4][1] + " " + prose(rng, 600))  # under a twentieth of the words
    texts += [f"{prose(rng, 30)} password: deadbeef0123456789abcdef {prose(rng, 9)}" for _ in range(3)] + ["", None, prose(rng, 4000)]
    docs = [(i * 3, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i * 3, int(not 60 <= i < 90), 0) for i in range(100)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def test_run_by_brute_force(spark, folder):
    path, docs, items = folder
    read = spark.read.parquet
    score = C.train(sample(read(f"{path}/documents.parquet"), read(f"{path}/labels.parquet"), "quality", C.PER_CLASS)).scorer()
    kept = [d for d in docs if score([d[1] or ""])[0] >= 0.3]
    assert sum(60 <= d[0] // 3 < 90 for d in kept) <= 3 and len(kept) >= 70
    prints = {d[0]: literal_fingerprint(d[1] or "") for d in kept}
    ids = sorted(prints)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = least_reachable(ids, links)
    kept = [d for d in kept if root[d[0]] == d[0]]
    dirty = {key for key, _, n_hit, _, _ in brute([d[:2] for d in kept], items) if n_hit}
    assert len(dirty) >= 4
    known = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=__import__("driftmark.llm.bpe", fromlist=["x"]).load_ranks(public.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    expected = {d[0]: known.encode_ordinary(secrets.redact(d[1] or "")) for d in kept if d[0] not in dirty}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert {i: r.ids for i, r in got.items()} == expected
    assert all(r.ids_sha256 == hashlib.sha256(np.array(expected[i], "<u4").tobytes()).hexdigest() for i, r in got.items())


def test_stages_keep_columns_and_take_odd_tables(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumns({c: F.lit(1) for c in ("score", "kept", "safe", "row", "words", "_text", "fp")})
    doubled = docs.unionByName(docs.filter("doc_id < 30")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("bigint")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, doubled, path)
        assert out.columns == docs.columns and out.count() > 0
        assert stage(spark, docs.limit(0), path).count() == 0


def test_near_dedup_keeps_one_row_of_each_document(spark, folder):
    path, docs, _ = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    once = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, path).collect())
    twice = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame.unionByName(frame), path).collect())
    assert once == twice and len(once) < len(docs)


def test_near_dedup_decides_rows_without_own_id_by_group(spark, folder):
    path, _, _ = folder
    rng = random.Random(8)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, d), (2, e), (3, e), (2, d), (None, a + " "), (None, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({x: F.lit("x") for x in ("fp", "root", "component", "kept", "n", "a.b", "least")})
    got = corpus_pipeline.near_dedup(spark, frame.repartition(4), path)
    assert got.columns == frame.columns
    assert sorted([r[:2] for r in got.collect()], key=str) == sorted([(None, a), (None, b), (1, c), (2, d), (2, e), (None, None)], key=str)


def test_secret_stage_redacts_and_counts(spark, folder):
    path, docs, _ = folder
    out = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    assert len(out) == len(docs)
    for i, text, _, _, n in docs:
        assert out[i].text == (None if text is None else secrets.redact(text))
        assert out[i].n_chars == (None if n is None else len(out[i].text))


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_queries_against_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    expected = connection.sql(sql.ORACLES[name]).df()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, expected[columns].values.tolist()))


def test_every_query_is_registered():
    found = queries.queries()
    assert [n.split("_")[0] for n in found if n != "pipeline"] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(found)
