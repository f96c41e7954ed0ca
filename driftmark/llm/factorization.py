"""Toxicity: a factorization machine over hashed terms.

A text's features are the hashed terms that it holds: its words and the beginnings of its
longer words. Besides a weight for each term, the machine learns a vector for each term;
the product of two vectors is the weight of both terms together, so an insult next to the
mention of a group can count for more than the sum of the two, which no additive model
learns. Training is stochastic gradient descent with per-coordinate rates, on at most
2 * PER_CLASS labelled documents (see labelled.sample). Terms have weights that tell
something in the training documents, alone or in a pair (see telling and interacting), so a
term that stands in most texts of either class still enters the pairs in which it counts.
No label, language, source or id enters a score.

Defined cases: null text is empty, and the score of a text without known terms is that of
the bias; without labelled rows of both classes every score is 0.5; rows are scored one by
one, so ties and repeated rows score alike; an empty table gives no rows; a column of the
table that is named like the score is replaced by it unless it is kept, and columns that are
not named are not read. Whole texts are scored: each distinct term counts once, however long
the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftmark.llm.common import map_text

PER_CLASS = 6000
HASH_BITS = 20
FACTORS = 6
MIN_DOCS = 5
MIN_LIFT = 2.0
MIN_SIGMA = 3.0
#: Pairs are looked for among terms of this share of the training texts, so many terms at a time.
PAIR_SHARE = 0.01
PAIR_SIGMA = 6.0
PAIR_BLOCK = 4
EPOCHS = 16
BATCH = 128
RATE = 0.08
RIDGE = 1e-4
#: Bytes of the beginning of a longer word that count as a term.
STEM = 5

#: ASCII other than letters and digits separates words.
_SPLIT = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> np.ndarray:
    """Distinct hashed terms of a text."""
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split())
    stems = {w[:STEM] + b"*" for w in words if len(w) > STEM}
    both = np.fromiter(map(zlib.crc32, words | stems), np.uint32, len(words) + len(stems))
    return np.unique(both >> np.uint32(32 - HASH_BITS)).astype(np.int64)


@dataclass
class Machine:
    bias: float = 0.0
    #: Hashed term to row of the weights; -1 where a term has none.
    row: np.ndarray = field(default_factory=lambda: np.full(1 << HASH_BITS, -1, np.int32))
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS)))
    trained: bool = False

    def margin(self, hashed: np.ndarray) -> float:
        rows = self.row[hashed]
        rows = rows[rows >= 0]
        v = self.factors[rows]
        total = v.sum(0)
        return float(self.bias + self.linear[rows].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, text: str) -> float:
        if not self.trained:
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(self.margin(terms(text)), -30, 30))))


def telling(found: Sequence[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Terms that tell something, alone or in a pair; others would only add noise, the more the
    longer a text is.

    Alone: the term's share differs between the classes by the factor MIN_LIFT at least, and by
    MIN_SIGMA standard errors. In a pair: see interacting().
    """
    size = 1 << HASH_BITS
    count = {v: np.bincount(np.concatenate([f for f, y in zip(found, labels, strict=True) if y == v]), minlength=size) for v in (0, 1)}
    total = {v: float((labels == v).sum()) for v in (0, 1)}
    share = {v: (count[v] + 0.5) / (total[v] + 1) for v in (0, 1)}
    pooled = (count[0] + count[1] + 1) / (total[0] + total[1] + 2)
    error = np.sqrt(pooled * (1 - np.minimum(pooled, 0.999)) * (1 / total[0] + 1 / total[1]))
    lift = np.abs(np.log(share[1] / share[0]))
    held = count[0] + count[1]
    alone = np.flatnonzero((held >= MIN_DOCS) & (lift >= np.log(MIN_LIFT)) & (np.abs(share[1] - share[0]) >= MIN_SIGMA * error))
    often = np.flatnonzero((held >= max(MIN_DOCS, PAIR_SHARE * len(labels))) & (held < len(labels)))
    return np.union1d(alone, interacting(found, labels, often))


def interacting(found: Sequence[np.ndarray], labels: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Terms of pairs whose effect is not the sum of the two: an insult that only counts beside a
    group mention, or one of two words but not both, may each tell nothing alone.

    The texts with both, either and neither of two terms give four rates of label 1; the
    contrast of the rates is zero where effects add up. A pair counts whose contrast exceeds
    PAIR_SIGMA standard errors and whose four groups have MIN_DOCS texts each.
    """
    bits = {v: _held([f for f, y in zip(found, labels, strict=True) if y == v], often) for v in (0, 1)}
    texts = {v: np.bitwise_count(x).sum(1, dtype=np.int64) for v, x in bits.items()}
    out = np.zeros(len(often), bool)
    for start in range(0, len(often), PAIR_BLOCK):
        block, rest = slice(start, start + PAIR_BLOCK), slice(start, None)  # each pair once
        contrast, variance, least = 0.0, 0.0, np.inf
        one, other, total = {}, {}, {}
        for v, x in bits.items():
            one[v], other[v] = texts[v][block, None], texts[v][None, rest]
            total[v] = np.bitwise_count(x[block, None] & x[None, rest]).sum(2, dtype=np.int64)
        # texts and texts of label 1: with both, the first alone, the second alone, neither
        for sign, cell in ((1, lambda v: total[v]), (-1, lambda v: one[v] - total[v]), (-1, lambda v: other[v] - total[v]), (1, lambda v: (labels == v).sum() - one[v] - other[v] + total[v])):
            hits = cell(1)
            size = hits + cell(0)
            rate = (hits + 0.5) / (size + 1)
            contrast, variance, least = contrast + sign * rate, variance + rate * (1 - rate) / (size + 1), np.minimum(least, size)
        strong = (least >= MIN_DOCS) & (np.abs(contrast) >= PAIR_SIGMA * np.sqrt(variance))
        out[block] |= strong.any(1)
        out[rest] |= strong.any(0)
    return often[out]


def _held(found: Sequence[np.ndarray], terms: np.ndarray) -> np.ndarray:
    """Which texts hold each term, a bit for a text."""
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    out = np.zeros((len(terms), -(-len(found) // 64) * 8), np.uint8)
    for i, f in enumerate(found):
        at = place[f]
        out[at[at >= 0], i >> 3] |= np.uint8(1 << (i & 7))
    return out.view(np.uint64)


def train(examples: Sequence[tuple[str, int]], seed: int = 7) -> Machine:
    labels = np.array([label for _, label in examples], float)
    if not len(labels) or labels.min() == labels.max():
        return Machine()
    found = [terms(text) for text, _ in examples]
    active = telling(found, labels)
    out = Machine(trained=True)
    out.row[active] = np.arange(len(active))
    rows = [r[r >= 0] for r in (out.row[f] for f in found)]
    weights = np.where(labels == 1, (labels == 0).sum() / labels.sum(), 1.0)  # both classes count alike
    rng = np.random.default_rng(seed)
    n = len(active)
    linear, factors = np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))
    bias, past_bias = 0.0, 1e-6
    past_linear, past_factors = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            picked = order[start : start + BATCH]
            sizes = np.array([len(rows[i]) for i in picked])
            flat = np.concatenate([rows[i] for i in picked])
            text = np.repeat(np.arange(len(picked)), sizes)  # a text without terms trains the bias
            v = factors[flat]
            total = np.stack([np.bincount(text, v[:, f], len(picked)) for f in range(FACTORS)], 1)
            margin = bias + np.bincount(text, linear[flat], len(picked)) + 0.5 * ((total**2).sum(1) - np.bincount(text, (v * v).sum(1), len(picked)))
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[picked]) * weights[picked] / len(picked)
            each = np.repeat(slope, sizes)
            own, at = np.unique(flat, return_inverse=True)
            step = np.bincount(at, each, len(own)) + RIDGE * linear[own]
            pull = each[:, None] * (total[text] - v)
            turn = np.stack([np.bincount(at, pull[:, f], len(own)) for f in range(FACTORS)], 1) + RIDGE * factors[own]
            past_linear[own] += step**2
            past_factors[own] += turn**2
            past_bias += slope.sum() ** 2
            linear[own] -= RATE * step / np.sqrt(past_linear[own])
            factors[own] -= RATE * 0.5 * turn / np.sqrt(past_factors[own])
            bias -= RATE * slope.sum() / np.sqrt(past_bias)
    out.bias, out.linear, out.factors = bias, linear, factors
    return out


def score_toxicity(df: DataFrame, model: Machine, text: str = "text", keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the probability of label 1; one row for each input row, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by 2**HASH_BITS and the sample

    def make() -> Callable[[list[str]], dict]:
        machine = shared.value
        return lambda texts: {name: [machine.score(x) for x in texts]}

    return map_text(df, text, make, [(name, T.DoubleType())], keep)
