"""Hashed word n-grams and follow-the-regularised-leader (FTRL-proximal) logistic regression."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from tideline.llm.text import LOWER, WORDS_AND_PUNCTUATION, hashes, pair, tokens

BITS = 18
BUCKETS = 1 << BITS
#: The slot after the hashed ones: a token that repeats the one before it.
REPEAT = BUCKETS


def ngrams(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of unigrams and of bigrams (-1 where the next token is in another row), and first tokens of rows.

    Tokens are runs of word characters or of punctuation. A bigram of two equal tokens
    also falls into REPEAT; it is given as REPEAT here, as its own slot says no more.
    """
    low, high = int(offsets[0]), int(offsets[-1])
    piece = data[low:high]
    starts, ends, pointer = tokens(piece, offsets - low, WORDS_AND_PUNCTUATION)
    h = hashes(LOWER[piece] if lower else piece, starts, ends)
    shift = np.uint64(64 - BITS)
    one = (h >> shift).astype(np.int64)
    two = np.full(len(h), -1, np.int64)
    if len(h) > 1:
        two[:-1] = (pair(h[:-1], h[1:]) >> shift).astype(np.int64)
        two[:-1][h[:-1] == h[1:]] = REPEAT
        last = pointer[1:] - 1
        two[last[np.diff(pointer) > 0]] = -1
    elif len(h):
        two[0] = -1
    return one, two, pointer


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2 terms; the last weight is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0
        return w

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One example with distinct slots at, their values x and its label y."""
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w, n = self.weights(at), self.n[at]
        g = (sigmoid(w @ x) - y) * x
        squares = g * g
        self.z[at] += g - (np.sqrt(n + squares) - np.sqrt(n)) / self.alpha * w
        self.n[at] += squares


def fit(examples: Iterable[tuple[np.ndarray, np.ndarray, float]], size: int, epochs: int, seed: int, **parameters: float) -> np.ndarray:
    """Weights (bias last) after some epochs over the examples in seeded orders."""
    model = Ftrl(size, **parameters)
    examples = examples if hasattr(examples, "__getitem__") else list(examples)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            model.learn(*examples[i])
    return model.weights()
