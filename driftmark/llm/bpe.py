"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decode.

A sequence of tokens is what the merges make of its bytes exactly if each pair of
neighbours is: merging the two tokens' bytes gives back those two tokens. So the encoding
of every prefix of a piece follows from those of shorter prefixes: of the tokens that end
with the prefix, exactly one may follow the last token of what stands before it.

Which tokens may end, and which are under way, depends on the bytes alone. The transducer's
states are the sets of vocabulary trie nodes that the bytes so far may be inside of, found by
the subset construction when a text first needs them; its output at each byte is the token
that ends there and fits. Prefixes from which a token is under way are the lookahead, which
the longest token bounds: tokens that the encodings of all of these share are emitted.
Transitions and pairs are kept in tables of bounded size that start afresh when full, which
changes no result.

Decoding feeds token bytes to a UTF-8 state machine that holds an incomplete character
from one call to the next.

Defined cases: null text is empty and has no tokens; rows are answered one by one, so
ties and repeated rows each give a row; an empty table gives no rows; other columns may have
any name and are not read. A text of any length takes memory in proportion to itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftmark.llm.common import map_text

#: Transitions and pieces that a worker keeps.
MAX_TRANSITIONS = 300_000
MAX_PAIRS = 300_000
MAX_PIECES = 250_000
#: Bytes of a piece after which tokens that are certain are emitted; twice the longest token at least.
LOOKAHEAD = 1024
NO_TOKEN = -1


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeTable:
    """Ranks as merges: the reference against which pairs of tokens are compiled."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._whole: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The lowest-ranked neighbours merge first, the leftmost of equals."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        if (known := self._whole.get(token)) is None:
            known = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return known

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge is made last for this one; None for a single byte."""
        if token not in self._halves:
            data, found = self.tokens[token], None
            for i in range(1, len(data)):
                left, right = self.ranks.get(data[:i]), self.ranks.get(data[i:])
                if left is not None and right is not None and self.whole(left) and self.whole(right) and self._unmerged(left, right, token):
                    found = left, right
                    break
            self._halves[token] = found
        return self._halves[token]

    def _unmerged(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge ranked below limit crosses the border of two tokens, while both are built.

        The merges inside both are undone from the latest; after each, the tokens that touch
        the border must not have a merge that comes before the one undone.
        """
        tokens, rank_of = self.tokens, self.ranks.get
        while True:
            rank = rank_of(tokens[left] + tokens[right])
            if rank is not None and rank < limit:
                return False
            # the later merge is undone; of two equal tokens the left one is made first
            if left > right:
                first, second = (left, 0), (right, 1)
            else:
                first, second = (right, 1), (left, 0)
            for token, side in (first, second):
                if parts := self.halves(token):
                    if side:
                        limit, right = token + 1, parts[0]
                    else:
                        limit, left = token, parts[1]
                    break
            else:
                return True

    def follows(self, left: int, right: int) -> bool:
        """Whether merging both tokens' bytes gives both tokens."""
        key = left << 32 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._unmerged(left, right, len(self.tokens) + 1 << 32)
        return known


class Transducer:
    """Bytes of a piece in, tokens out."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.merges = MergeTable(ranks)
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [NO_TOKEN]
        self.grows: list[bool] = [False]
        self.depth: list[int] = [0]
        self.size = [0] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            node = 0
            for depth, byte in enumerate(token, 1):
                self.grows[node] = True
                nxt = self.child.get(node << 8 | byte)
                if nxt is None:
                    nxt = self.child[node << 8 | byte] = len(self.token_at)
                    self.token_at.append(NO_TOKEN)
                    self.grows.append(False)
                    self.depth.append(depth)
                node = nxt
            self.token_at[node] = rank
            self.size[rank] = len(token)
        self._forget()

    def _forget(self) -> None:
        #: A state is the set of trie nodes that the bytes so far may be inside of, the root aside.
        self.states: list[tuple[int, ...]] = [()]
        self.number: dict[tuple[int, ...], int] = {(): 0}
        #: state << 8 | byte to the next state and the tokens that may end with this byte.
        self.steps: dict[int, tuple[int, tuple[tuple[int, int], ...]]] = {}

    def _step(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int], ...]]:
        """Determinise one transition."""
        inside, ends = [], []
        for node in (*self.states[state], 0):
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if token != NO_TOKEN and self.merges.whole(token):
                ends.append((token, self.size[token]))
            if self.grows[nxt]:
                inside.append(nxt)
        key = tuple(inside)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        made = self.steps[state << 8 | byte] = number, tuple(ends)
        return made

    def encode(self, piece: bytes) -> list[int]:
        if (known := self.merges.ranks.get(piece)) is not None:
            return [known]
        if len(self.steps) >= MAX_TRANSITIONS:
            self._forget()
        step, pairs, follows = self.steps.get, self.merges.pairs, self.merges.follows
        out: list[int] = []
        last = [NO_TOKEN]  # the last token of the encoding of each prefix, from the last emitted token on
        state = 0
        for byte in piece:
            got = step(state << 8 | byte)
            if got is None:
                got = self._step(state, byte)
            state, ends = got
            here = len(last)
            for token, size in ends:  # of one token only the prefix before it and it are neighbours by merges
                before = last[here - size]
                if before < 0:
                    last.append(token)
                    break
                fits = pairs.get(before << 32 | token)
                if fits is None:
                    fits = follows(before, token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
            if here >= LOOKAHEAD:
                last = self._emitted(state, last, out)
        return out + self._back(last, len(last) - 1)

    def _back(self, last: list[int], at: int) -> list[int]:
        """The encoding of the prefix that ends there, from the last emitted token on."""
        tokens = []
        while at > 0:
            tokens.append(last[at])
            at -= self.size[last[at]]
        return tokens[::-1]

    def _emitted(self, state: int, last: list[int], out: list[int]) -> list[int]:
        """Emits the tokens that the encodings of all live prefixes share; what is left of last."""
        here = len(last) - 1
        live = {here, *(here - self.depth[node] for node in self.states[state])}
        while len(live) > 1:  # the latest gives way to the prefix before its last token
            at = max(live)
            live.discard(at)
            live.add(at - self.size[last[at]])
        (common,) = live
        out += self._back(last, common)
        return last[common:]


class Encoder:
    """Splits texts into pieces by a pattern and encodes each piece; frequent pieces are kept."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words = {rank: rank.to_bytes(4, "little") for rank in ranks.values()}

    def packed(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        pieces = self.pattern.findall(text)
        parts = list(map(self.kept.get, pieces))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = self._fresh(pieces[i])
        return b"".join(parts)

    def _fresh(self, piece: str) -> bytes:
        """A piece that was not seen of late."""
        got = self.kept.get(piece) or self.older.get(piece)
        if got is None:
            got = b"".join(map(self.words.__getitem__, self.transducer.encode(piece.encode("utf-8", "surrogatepass"))))
        if len(piece) <= 64:
            if len(self.kept) >= MAX_PIECES:  # what has not been seen since the last turn is forgotten
                self.older, self.kept = self.kept, {}
            self.kept[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()


def _utf8_table() -> np.ndarray:
    """next[state, byte] of a UTF-8 acceptor: 0 complete, 1 refused, then bytes that are still due.

    States 2, 3, 4: one, two, three continuation bytes due; 5 to 8: those whose first one is
    limited (after E0: A0-BF, ED: 80-9F, F0: 90-BF, F4: 80-8F).
    """
    step = np.ones((9, 256), np.uint8)
    step[0, :0x80] = 0
    step[0, 0xC2:0xE0] = 2
    step[0, 0xE0:0xF0] = 3
    step[0, 0xF0:0xF5] = 4
    step[0, [0xE0, 0xED, 0xF0, 0xF4]] = [5, 6, 7, 8]
    for state, low, high, then in ((2, 0x80, 0xC0, 0), (3, 0x80, 0xC0, 2), (4, 0x80, 0xC0, 3), (5, 0xA0, 0xC0, 2), (6, 0x80, 0xA0, 2), (7, 0x90, 0xC0, 3), (8, 0x80, 0x90, 3)):
        step[state, low:high] = then
    return step


class StreamingDecoder:
    """Token ids to text, in any portions: an incomplete character waits for the next call.

    The state machine runs over tokens: what a token does to a state is found byte by byte
    once and kept. A token that the machine refuses makes the text malformed; feed() then
    writes U+FFFD for the refused bytes, and malformed is set.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.step = _utf8_table().tolist()
        self.known: dict[int, int] = {}
        plain = [self._run(0, token) == 0 for token in self.tokens]
        self.plain = np.array(plain, bool)
        self.reset()

    def reset(self) -> None:
        self.state, self.waiting, self.malformed = 0, b"", False

    def _run(self, state: int, data: bytes) -> int:
        for byte in data:
            state = self.step[state][byte]
            if state == 1:
                return 1
        return state

    def feed(self, ids: Sequence[int] | np.ndarray) -> str:
        return self.feed_bytes(ids).decode("utf-8", "replace" if self.malformed else "strict")

    def feed_bytes(self, ids: Sequence[int] | np.ndarray) -> bytes:
        """Bytes of all characters that are complete; the rest waits."""
        ids = np.asarray(ids, np.int64)
        listed = ids.tolist()
        data = self.waiting + b"".join(map(self.tokens.__getitem__, listed))
        for i in np.flatnonzero(~self.plain[ids]).tolist():  # between these the state stays as it is
            key = self.state * len(self.tokens) + listed[i]
            state = self.known.get(key)
            if state is None:
                state = self.known[key] = self._run(self.state, self.tokens[listed[i]])
            if state == 1 or (self.state and self.plain[listed[i - 1]] and i):
                self.malformed, state = True, 0
            self.state = state
        if self.state and listed and self.plain[listed[-1]]:
            self.malformed, self.state = True, 0
        due = self._due(data) if self.state else 0
        self.waiting = data[len(data) - due :]
        return data[: len(data) - due]

    @staticmethod
    def _due(data: bytes) -> int:
        """Bytes of the character that data breaks off in."""
        for back in range(1, min(4, len(data)) + 1):
            if data[-back] >= 0xC0:
                return back
        return 0

    def finish_bytes(self) -> bytes:
        """What waits at the end of the stream: an incomplete character's bytes."""
        rest = self.waiting
        self.reset()
        return rest


_made: dict[tuple[str, str], tuple[Encoder, StreamingDecoder]] = {}


def coder(path: str, pattern: str) -> tuple[Encoder, StreamingDecoder]:
    """The worker's encoder and decoder of a vocabulary, whose transitions outlive a task."""
    if (path, pattern) not in _made:
        ranks = load_ranks(path)
        _made.clear()
        _made[path, pattern] = Encoder(ranks, pattern), StreamingDecoder(ranks)
    return _made[path, pattern]


def portions(ids: np.ndarray, size: int = 1 << 16) -> Iterator[np.ndarray]:
    for start in range(0, len(ids), size):
        yield ids[start : start + size]


def digests(encoded: Iterable[np.ndarray], decoder: StreamingDecoder) -> dict[str, list]:
    """Counts and digests of ids and of the bytes that the ids decode to."""
    out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for ids in encoded:
        digest = hashlib.sha256()
        decoder.reset()
        for part in portions(ids):
            digest.update(decoder.feed_bytes(part))
        digest.update(decoder.finish_bytes())
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
        out["decoded_sha256"].append(digest.hexdigest())
    return out


def round_trip(encoder: Encoder, decoder: StreamingDecoder, texts: Iterable[str]) -> dict[str, list]:
    return digests((np.frombuffer(encoder.packed(text), "<u4") for text in texts), decoder)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, ids: array<int>, ids_sha256, decoded_sha256. path is read by
    every worker: a vocabulary is installed, not data."""

    def make() -> Callable[[list[str]], dict]:
        encoder, decoder = coder(path, pattern)

        def apply(texts: list[str]) -> dict:
            ids = [np.frombuffer(encoder.packed(x), "<u4") for x in texts]
            return {"ids": [x.view(np.int32) for x in ids], **digests(ids, decoder)}

        return apply

    fields = [("n_tokens", T.LongType()), ("ids", T.ArrayType(T.IntegerType())), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_text(df, text, make, fields, keep)


def digest_round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, ids_sha256, decoded_sha256 of encoding and decoding again."""

    def make() -> Callable[[list[str]], dict]:
        encoder, decoder = coder(path, pattern)
        return lambda texts: round_trip(encoder, decoder, texts)

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_text(df, text, make, fields, keep)
