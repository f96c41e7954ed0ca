import hashlib

from pyspark.sql import functions as F

from driftmark.llm.chat_format import PART, escape, format_chats, masked_text, read_back, unescape

TRICKY = ["", "plain", "\\", "\\b\\l", "<turn:user>\nhi</turn>\n", "\\<", "<\\", "a\\\\<<b", "ünï 文 <image:0.0>", None]


def test_escape_reads_back(spark):
    rows = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    got = rows.select("t", unescape(escape(F.col("t"))).alias("u"), unescape(escape(F.col("t"), role=True), role=True).alias("r"), escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.u == r.r for r in got)
    assert all("<" not in r.e for r in got if r.e)


def test_texts_roles_and_masks_survive(spark):
    turns = [(1, i, role, text) for i, (role, text) in enumerate(zip(["user", "assistant", "sys>\ntem", "assistant", None] * 2, TRICKY, strict=True))]
    turns += [(2, None, "assistant", "first"), (2, 0, "user", "second"), (2, 0, "user", "second"), (None, 1, "assistant", "lost")]
    out = format_chats(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(3))
    got = {r.conv_id: r for r in out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(role or "", text or "") for _, _, role, text in turns[:10]]
    assert got[1].loss == "".join(text or "" for _, _, role, text in turns[:10] if role == "assistant")
    assert [t.text for t in got[2].turns] == ["first", "second", "second"]
    assert got[None].loss == "lost"
    assert len(got) == 3


def test_parts_become_placeholders_with_references(spark):
    parts = [
        {"kind": "text", "text": "see <this>"},
        {"kind": "image", "ref": "s3://a.png", "width": 28, "height": 15},
        {"kind": "audio", "ref": "b.wav", "seconds": 1.5},
        {"kind": "document", "ref": "c.pdf", "pages": 2},
        {"kind": "hologram", "ref": "d"},
        {"kind": None, "text": "end now"},
    ]
    rows = spark.createDataFrame([(5, 0, "user", parts), (5, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts array<{PART}>")
    r = format_chats(rows, parts=F.col("parts")).first()
    assert r.formatted == "<turn:user>\nsee \\lthis><image:0.1><audio:0.2><document:0.3><unknown:0.4>end now</turn>\n<turn:assistant>\n</turn>\n"
    assert [(a.placeholder, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        ("<image:0.1>", "image", "s3://a.png", 4),
        ("<audio:0.2>", "audio", "b.wav", 38),
        ("<document:0.3>", "document", "c.pdf", 1024),
        ("<unknown:0.4>", "unknown", "d", 0),
    ]
    assert r.expanded_tokens == 2 + 4 + 38 + 1024 + 2
    assert [(s.start, s.end) for s in r.loss_spans] == [(len(r.formatted) - 8, len(r.formatted) - 8)]


def test_no_rows_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, conv string, at int")
    assert format_chats(empty).count() == 0
    one = spark.createDataFrame([(1, 1, "user", "x", "c", 9, "s")], "conv_id bigint, turn bigint, role string, text string, conv string, at int, segment string")
    assert format_chats(one).first().formatted == "<turn:user>\nx</turn>\n"
    assert hashlib.sha256(b"").hexdigest() == one.select(F.sha2(F.lit(""), 256)).first()[0]


def test_very_long_texts(spark):
    text = "a < b \\ c > d " * 200_000
    out = format_chats(spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string"))
    r = out.select(read_back(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert r.turns[1].text == text and r.loss == text
