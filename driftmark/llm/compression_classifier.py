"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled texts. A text
is compressed with each in blocks of BLOCK_BYTES, every block with the fresh dictionary, so
that the end of a long text counts as its beginning does; the normalised difference of the
summed sizes says which class it is more like. A logistic calibration, fitted on labelled
texts that neither dictionary has seen, turns the difference into a probability. Beside the
difference, per byte and per compressed byte, it gets the three compressed sizes per byte,
which place it: where a text is nearly all repetition both sizes are small, and so is any
difference. The length is no input. No label, language, source or id enters a score.

Training uses at most 2 * PER_CLASS documents (see labelled.sample), half of each class
for the dictionaries and half for the calibration. A dictionary is a small choice of its
texts' substrings: each text offers the same share, spread over the whole of it. The
calibration compresses whole texts, and so does scoring.

Defined cases: null text is empty and gets a score like any other; without labelled rows
of both classes every score is 0.5; each row is scored on its own, so ties and repeated
rows score alike; an empty table gives no rows; a column of the table that is named like the
score is replaced by it unless it is kept, and columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftmark.llm.common import map_text

PER_CLASS = 6000
DICTIONARY_BYTES = 112_640
#: Share of each text in what a dictionary is chosen from, so that a long text does not crowd
#: out the others, and the bytes of each of its pieces.
TEXT_SHARE = 4000
PIECE_BYTES = 500
#: Bytes that are compressed at a time.
BLOCK_BYTES = 8192
LEVEL = 3
#: Keeps the ratios of very short texts within bounds.
PAD = 16
PLAIN = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}


def pieces(text: bytes) -> list[bytes]:
    """The text, or of a longer one pieces of together TEXT_SHARE bytes at even distances from start to end."""
    if len(text) <= TEXT_SHARE:
        return [text] if text else []
    n = TEXT_SHARE // PIECE_BYTES
    starts = [i * (len(text) - PIECE_BYTES) // (n - 1) for i in range(n)]
    return [text[at : at + PIECE_BYTES] for at in starts]


def dictionary(texts: Sequence[bytes]) -> bytes:
    """Dictionary content for texts of one kind; of too few texts to train on, the texts themselves."""
    found = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(found)


class Sizes:
    """Compressed sizes of a text, block by block: with the good, with the bad and without a dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.with_good, self.with_bad = (self._compressor(x) for x in (good, bad))
        self.without = zstandard.ZstdCompressor(level=1, **PLAIN)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        if not content:
            return zstandard.ZstdCompressor(level=LEVEL, **PLAIN)
        data = zstandard.ZstdCompressionDict(content)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **PLAIN)

    def features(self, text: bytes) -> list[float]:
        n = len(text) + PAD
        blocks = [text[at : at + BLOCK_BYTES] for at in range(0, len(text), BLOCK_BYTES)] or [b""]
        good, bad, plain = (sum(len(c.compress(b)) for b in blocks) for c in (self.with_good, self.with_bad, self.without))
        least = min(good, bad)
        return [(bad - good) / n, (bad - good) / max(good, bad, 1), least / n, plain / n, (plain - least) / n]


def _expanded(features: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((features - mean) / spread, -5, 5)
    return np.hstack([np.ones((len(z), 1)), z, *[z[:, [i]] * z[:, i:] for i in range(z.shape[1])]])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * len(x) * w
        curve = (x.T * (p * (1 - p) + 1e-6)) @ x + ridge * len(x) * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class CompressionModel:
    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def scorer(self) -> Callable[[list[str]], np.ndarray]:
        sizes = Sizes(self.good, self.bad)
        mean, spread, weights = map(np.array, (self.mean, self.spread, self.weights))

        def score(texts: list[str]) -> np.ndarray:
            if not len(weights) or not texts:
                return np.full(len(texts), 0.5)
            x = np.array([sizes.features(t.encode("utf-8", "surrogatepass")) for t in texts])
            return 1 / (1 + np.exp(-np.clip(_expanded(x, mean, spread) @ weights, -30, 30)))

        return score


def train(examples: Sequence[tuple[str, int]]) -> CompressionModel:
    """A model from (text, label) pairs; label 1 is good."""
    classes = {v: [t.encode("utf-8", "surrogatepass") for t, label in examples if label == v] for v in (0, 1)}
    if not classes[0] or not classes[1]:
        return CompressionModel()
    seen = {v: x[::2] for v, x in classes.items()}
    fresh = {v: x[1::2] or x for v, x in classes.items()}
    good, bad = dictionary(seen[1]), dictionary(seen[0])
    sizes = Sizes(good, bad)
    x = np.array([sizes.features(t) for v in (1, 0) for t in fresh[v]])
    y = np.array([v for v in (1, 0) for _ in fresh[v]], float)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    weights = _logistic(_expanded(x, mean, spread), y)
    return CompressionModel(good, bad, tuple(mean), tuple(spread), tuple(weights))


def score_quality(df: DataFrame, model: CompressionModel, text: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the probability of label 1; one row for each input row, no shuffle."""

    def make() -> Callable[[list[str]], dict]:
        score = model.scorer()
        return lambda texts: {name: score(texts)}

    return map_text(df, text, make, [(name, T.DoubleType())], keep)
