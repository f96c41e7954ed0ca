"""Chat formatting: typed content parts become one training text with a loss mask.

A visitor flattens each turn's parts in order: text parts are escaped, image, audio and
document parts become placeholders ``<kind:turn.part>`` whose references and expanded
token counts are recorded as attachments. Only DataFrame functions are used.

Template of a turn: ``<turn:ROLE>\\n`` BODY ``</turn>\\n``. Inside texts a backslash is
written ``\\b`` and ``<`` is written ``\\l`` (in roles also ``>`` as ``\\g``), so an
unescaped ``<`` can only start a control string and every text reads back unchanged.

Defined cases: null text, role or part list: empty; unknown or null part kinds with text
are text, others become ``<unknown:..>`` placeholders of no tokens; turns sort by turn
(null first), then role, then parts, so ties and repeated rows keep a fixed order and are
all kept; a null conversation id is a conversation of its own; a conversation of any length is
one row, of at most 2 GB as any text is; an empty table gives no rows; other columns may have any
name and are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.llm.common import quoted

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
OPEN, HEAD_END, CLOSE = "<turn:", ">\n", "</turn>\n"


@dataclass(frozen=True)
class TokenCosts:
    """Tokens that an attachment expands to."""

    image_patch: int = 14
    audio_per_second: float = 25.0
    document_page: int = 512


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit(">"), F.lit("\\g")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    if role:
        text = F.replace(text, F.lit("\\g"), F.lit(">"))
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text column as a list of one text part."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
    return F.array(part).cast(f"array<{PART}>")


def _is_text(part: Column) -> Column:
    kind = part["kind"]
    return (kind.eqNullSafe(F.lit("text"))) | (~F.coalesce(kind.isin("image", "audio", "document"), F.lit(False)) & part["text"].isNotNull())


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("image", "audio", "document"), part["kind"]).otherwise(F.lit("unknown"))


def _mark(part: Column, turn: Column, at: Column) -> Column:
    return F.concat(F.lit("<"), _kind(part), F.lit(":"), turn.cast("string"), F.lit("."), at.cast("string"), F.lit(">"))


def _tokens(part: Column, costs: TokenCosts) -> Column:
    sides = [F.ceil(F.coalesce(part[s], F.lit(0)) / F.lit(costs.image_patch)) for s in ("width", "height")]
    return (
        F.when(_is_text(part), F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit("\\S+")).cast("long"))
        .when(part["kind"] == "image", (sides[0] * sides[1]).cast("long"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(costs.audio_per_second)).cast("long"))
        .when(part["kind"] == "document", (F.coalesce(part["pages"], F.lit(0)) * F.lit(costs.document_page)).cast("long"))
        .otherwise(F.lit(0).cast("long"))
    )


def format_chats(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: Column | None = None,
    loss_role: str = "assistant",
    costs: TokenCosts = TokenCosts(),
) -> DataFrame:
    """One row per conversation: formatted, loss_spans (code points, end exclusive),
    attachments, expanded_tokens. parts defaults to the text column as one part.

    One shuffle by conversation: running offsets come from a window over the same key, so
    no task holds more than the conversation that it writes.
    """
    rows = df.select(
        quoted(conversation).alias("conv"),
        quoted(turn).alias("turn"),
        F.coalesce(quoted(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(text_parts(F.col("text")) if parts is None else parts.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    at = F.row_number().over(order) - 1
    body = F.array_join(
        F.transform("parts", lambda p, j: F.when(_is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(_mark(p, F.col("at"), j))), ""
    )
    attached = F.filter(
        F.transform(
            "parts",
            lambda p, j: F.when(
                ~_is_text(p),
                F.struct(_mark(p, F.col("at"), j).alias("placeholder"), _kind(p).alias("kind"), p["ref"].alias("ref"), _tokens(p, costs).alias("tokens")),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    tokens = F.aggregate("parts", F.lit(0).cast("long"), lambda total, p: total + _tokens(p, costs))
    cut = (
        rows.withColumn("at", at)
        .withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(HEAD_END)))
        .withColumn("body", body)
        .select(
            "conv",
            "at",
            F.concat("head", "body", F.lit(CLOSE)).alias("segment"),
            F.char_length("head").alias("skip"),
            F.char_length("body").alias("length"),
            (F.col("role") == loss_role).alias("loss"),
            attached.alias("attached"),
            tokens.alias("tokens"),
        )
    )
    before = F.coalesce(F.sum(F.char_length("segment")).over(Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.withColumn("start", before + F.col("skip"))
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("length")).cast("long").alias("end"))
    turns = F.sort_array(F.collect_list(F.struct("at", "segment", "loss", span.alias("span"), "attached", "tokens")))
    return (
        placed.groupBy("conv")
        .agg(turns.alias("turns"))
        .select(
            F.col("conv").alias(conversation),
            F.array_join(F.col("turns.segment"), "").alias("formatted"),
            F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["span"]).alias("loss_spans"),
            F.flatten(F.col("turns.attached")).alias("attachments"),
            F.aggregate("turns", F.lit(0).cast("long"), lambda total, t: total + t["tokens"]).alias("expanded_tokens"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of struct<role, text>."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), HEAD_END, 1), role=True).alias("role"),
            unescape(F.substr(p, F.locate(HEAD_END, p) + F.lit(len(HEAD_END)))).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All unescaped text under the loss mask, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
