"""Secret scans with structural confirmation.

Three base patterns are found in the whole text, leftmost and non-overlapping for each
kind. The confirming pass then looks at every long base64, base64url or hex run of either
case, decodes it and reports a span of its own only if the bytes have the structure of a
credential:

``jwt``      three base64url parts; the first decodes to a JSON object that names an ``alg``
``der_key``  base64 or hex of a DER SEQUENCE whose nested lengths add up and whose content
             is that of a PKCS#1, PKCS#8 or SEC1 private key
``ssh_key``  base64 of the OpenSSH private key container with consistent nested lengths

A key in base64 may be wrapped in lines of any length after a first of LINE characters, with
real or written line breaks and indents: its own lengths say how many characters belong to it,
and that many are taken from the lines, up to a line's end or the padding. A full stop after a
token is not part of it.

Spans are code point offsets, end exclusive. Defined cases: null or empty text has no
spans; a very long text is scanned whole, by patterns that go forward only; every row is
answered on its own, so ties and repeated rows each give one row; an empty table gives no
rows; other columns may have any name and are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftmark.llm.common import map_text

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "der_key", "ssh_key")

#: Fixed patterns of the base kinds; lengths are those below which a match is dropped.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LENGTH = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: A token's header begins with a brace or with JSON's white space before it, in base64 e, I, C or D.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([eICD][A-Za-z0-9_-]{9,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)(?!\.?[A-Za-z0-9_-])")
#: A line break, real or written with backslashes, with the next line's indent.
BREAK = r"(?:\r?\n|(?:\\r)?\\n)[ \t]*"
#: First lines that can begin a key, and the lines after them, in base64 and base64url.
BLOCKS = {
    url: (re.compile(rf"(?:(?<![{c}])|(?<=\\n))(?:M[A-P]|b3BlbnNz)[{c}]+"), re.compile(rf"{BREAK}([{c}]+)"))
    for url, c in ((False, "A-Za-z0-9+/"), (True, "A-Za-z0-9_-"))
}
LINE = 16
BROKEN_PAD = re.compile(rf"{BREAK}=")
#: Hex that can begin a key, in either case.
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70)[0-9A-Fa-f]{60,}")
SSH_MAGIC = b"openssh-key-v1\x00"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The base matches of a text by start, then kind as listed."""
    found: list[Span] = []
    if ":" in text or "=" in text:  # an assignment has one
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def decode64(text: str, url: bool = False) -> bytes | None:
    """Bytes of a base64 run without white space, padding optional; None if it isn't one."""
    text = re.sub(r"[\r\n=]", "", text)
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, content start, content end) of the elements that fill data[start:end] exactly."""
    items = []
    while start < end:
        if start + 2 > end:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        start = at + size
    return items


def is_der_key(data: bytes) -> bool:
    """A private key in PKCS#1, PKCS#8 or SEC1 form, with all nested lengths in order."""
    outer = der_items(data, 0, len(data))
    if outer is None or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(data, *outer[0][1:])
    if not items or items[0][0] != 0x02 or items[0][2] - items[0][1] != 1:
        return False
    version, tags = data[items[0][1]], [tag for tag, _, _ in items]
    if version in (0, 1) and tags[:9] == [0x02] * 9:
        return True  # PKCS#1: nine integers at least
    if version in (0, 1) and tags[1:3] == [0x30, 0x04]:  # PKCS#8: algorithm, key
        algorithm = der_items(data, *items[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return version == 1 and tags[1:2] == [0x04] and 0 < items[1][2] - items[1][1] <= 66  # SEC1


def der_size(data: bytes) -> int | None:
    """Bytes of the element that the data begin, if it can be a key: a sequence that starts with a version."""
    if len(data) < 9 or data[0] != 0x30:
        return None
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    if n > 4 or data[1] == 0x80 or data[2 + n : 4 + n] != b"\2\1":
        return None
    return 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1])


def ssh_size(data: bytes) -> int | None:
    """Bytes of the OpenSSH container that the data begin: cipher, kdf and kdf options, then as many keys as it names."""
    if not data.startswith(SSH_MAGIC):
        return None
    at = len(SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, kdf, options = string(), string(), string()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    # an empty or missing string ends the walk, so it is no longer than the data
    return at if keys and all(string() for _ in range(keys)) and string() else None


def is_ssh_key(data: bytes) -> bool:
    return ssh_size(data) is not None


def is_token_header(text: str) -> bool:
    """A base64url part that holds a JSON object with a signing algorithm."""
    if (data := decode64(text, url=True)) is None:
        return False
    try:
        header = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def confirmed_spans(text: str, hexes: list[Span]) -> list[Span]:
    """Spans whose decoded bytes have the structure of a credential."""
    found: list[Span] = []
    if "." in text:
        found += tokens(text)
    found += key_blocks(text)
    runs = {(start, end) for start, end, _ in hexes} | {m.span() for m in HEX_KEY.finditer(text)}
    for start, end in sorted(runs):
        if (end - start) % 2 == 0 and end - start >= 64 and (kind := key_kind(bytes.fromhex(text[start:end]))):
            found.append((start, end, kind))
    return found


def tokens(text: str) -> Iterator[Span]:
    at = 0
    while m := TOKEN.search(text, at):
        named = is_token_header(m[1])
        if named:
            yield m.start(), m.end(), "jwt"
        at = m.end() if named else m.end(1)  # the next part may be the header


def key_blocks(text: str) -> set[Span]:
    """Keys in base64 or base64url, by their first lines; most runs are both."""
    found: set[Span] = set()
    for url, (first, after) in BLOCKS.items():
        if url and "-" not in text and "_" not in text:
            continue
        end = 0
        for m in first.finditer(text):
            if m.start() < end or len(m[0]) < LINE:
                continue
            if got := key_block(text, m, after, url):
                end = got[1]
                found.add(got)
    return found


def key_block(text: str, first: re.Match, after: re.Pattern, url: bool) -> Span | None:
    """The key that begins with a line: as many characters of it and the lines after it as its lengths name."""
    size = der_size(decode64(first[0][:16], url) or b"")
    if size is None and not first[0].startswith("b3"):
        return None
    lines, ends, n = [first[0]], [first.end()], len(first[0])
    need = None if size is None else -(-size * 8 // 6)
    while (need is None or n < need) and (m := after.match(text, ends[-1])):
        lines.append(m[1])
        ends.append(m.end())
        n += len(m[1])
    run = "".join(lines)
    if need is None:
        data = decode64(run[: len(run) // 4 * 4], url) or b""
        tail = decode64(run, url) if len(run) % 4 != 1 else None
        if (size := ssh_size(tail or data)) is None:
            return None
        need = -(-size * 8 // 6)
    elif n != need:
        return None
    data = decode64(run[:need], url)
    if not data or not (kind := key_kind(data)):
        return None
    total = 0
    for line, end in zip(lines, ends, strict=True):
        total += len(line)
        if total >= need:
            break
    pads = 0  # on the line, or broken off it
    while pads < 2 and text.startswith("=", end):
        end, pads = end + 1, pads + 1
    while pads < -need % 4 and (m := BROKEN_PAD.match(text, end)):
        end, pads = m.end(), pads + 1
        if pads < -need % 4 and text.startswith("=", end):
            end, pads = end + 1, pads + 1
    return first.start(), end, kind


def key_kind(data: bytes) -> str | None:
    return "der_key" if data[:1] == b"\x30" and is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by start and kind."""
    base = base_spans(text)
    more = confirmed_spans(text, [s for s in base if s[2] == "hex"])
    return base, ordered(base + more) if more else base


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, base and spans: array<struct<start, end, kind>>; one row for each input row."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))

    def make() -> Callable[[list[str]], dict]:
        def apply(texts: list[str]) -> dict:
            found = [scan(x) for x in texts]
            return {n: [[{"start": a, "end": b, "kind": k} for a, b, k in one[i]] for one in found] for i, n in enumerate(("base", "spans"))}

        return apply

    return map_text(df, text, make, [("base", span), ("spans", span)], keep)


def redactions(text: str) -> Iterator[tuple[int, int]]:
    """Disjoint spans to blank out, in order."""
    last: list[int] = []
    for start, end, _ in scan(text)[1]:
        if last and start <= last[1]:
            last[1] = max(last[1], end)
        else:
            if last:
                yield last[0], last[1]
            last = [start, end]
    if last:
        yield last[0], last[1]


def redact(text: str, mark: str = "[secret]") -> str:
    parts, at = [], 0
    for start, end in redactions(text):
        parts += [text[at:start], mark]
        at = end
    return "".join(parts) + text[at:] if parts else text


def redact_secrets(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "safe_text") -> DataFrame:
    """The kept columns and the text with every span replaced by a mark."""
    return map_text(df, text, lambda: lambda texts: {name: [redact(x) for x in texts]}, [(name, T.StringType())], keep)
