import random

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

from driftmark.llm import bpe  # noqa: E402

PATH = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def known(ranks):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_as_the_library(ranks, known, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_TRANSITIONS", 3000)  # the table starts afresh now and then
    machine, rng, tokens = bpe.Transducer(ranks), random.Random(2), list(ranks)
    for i in range(4000):
        kind = i % 4
        if kind == 0:
            piece = rng.randbytes(rng.randint(1, 24))
        elif kind == 1:
            piece = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6)))
        elif kind == 2:
            piece = rng.choice([b"a", b" ", b"\n", b"ab", "中".encode(), b"-="]) * rng.randint(1, 70)
        else:
            piece = bytes(rng.choice(b"abcdeXYZ \xc3\xa9") for _ in range(rng.randint(1, 30)))
        assert machine.encode(piece) == known._core_bpe.encode_single_piece(piece), piece


def test_pairs_as_merging_them(ranks):
    table, rng = bpe.MergeTable(ranks), random.Random(4)
    for _ in range(4000):
        a, b = rng.randrange(4000), rng.randrange(4000)
        assert table.follows(a, b) == (table.merged(table.tokens[a] + table.tokens[b]) == [a, b])


def test_texts_as_the_library(ranks, known, corpus):
    encoder = bpe.Encoder(ranks, public.PATTERN)
    for text in [t or "" for _, t in corpus] + ["it's  \n\n 12 <|endoftext|> 文字 ́a", "x" * 5000]:
        assert encoder.encode(text) == known.encode_ordinary(text)


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_streaming_decode_gives_whole_characters(ranks, size):
    encoder, decoder = bpe.Encoder(ranks, public.PATTERN), bpe.StreamingDecoder(ranks)
    text = "añ文𝄞 é" * 20 + "𐍈𐍈 end"
    ids = encoder.encode(text)
    parts = [decoder.feed(ids[i : i + size]) for i in range(0, len(ids), size)]
    assert "".join(parts) == text and decoder.finish_bytes() == b"" and not decoder.malformed


def test_broken_bytes_are_kept_and_told(ranks):
    decoder = bpe.StreamingDecoder(ranks)
    one = {bytes([b]): ranks[bytes([b])] for b in range(256)}
    data = b"a\xe4\xb8b\xff\xf0\x9d"
    got = decoder.feed_bytes([one[bytes([b])] for b in data])
    assert decoder.malformed and got + decoder.finish_bytes() == data


def test_utf8_machine_accepts_what_python_does():
    step, rng = bpe._utf8_table(), random.Random(1)

    def accepts(data: bytes) -> bool:
        state = 0
        for b in data:
            state = step[state, b]
        return state == 0

    for _ in range(5000):
        data = bytes(rng.choice([0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC1, 0xC3, 0xE0, 0xE4, 0xED, 0xF0, 0xF4, 0xF5]) for _ in range(rng.randint(1, 4)))
        try:
            data.decode()
            fine = True
        except UnicodeDecodeError:
            fine = False
        assert accepts(data) == fine, data


def test_table_round_trip(documents, corpus, known):
    rows = documents.selectExpr("doc_id", "text", "7 AS ids", "'q' AS n_tokens")
    got = {r.doc_id: r for r in bpe.encode_texts(rows, PATH, public.PATTERN).collect()}
    assert len(got) == len(corpus)
    for i, text in corpus:
        ids = known.encode_ordinary(text or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == __import__("hashlib").sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == __import__("hashlib").sha256((text or "").encode()).hexdigest()
    assert bpe.digest_round_trip(rows.limit(0), PATH, public.PATTERN).count() == 0
