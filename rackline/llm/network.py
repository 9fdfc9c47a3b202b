"""A bidirectional gated recurrent network with attention pooling, in numpy.

Input: windows of words.  A word enters as its own vector, if the training texts had it
often enough, and as the mean of the vectors of its character n-grams, ends marked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

GRAMS = (3, 4, 5)
BUCKETS = 1 << 15
WIDTH = 8
HIDDEN = 8
ATTENTION = 8


def gram_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all character n-grams, and the word that each belongs to."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), sizes)
    ids, owners = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        starts = np.flatnonzero(owner[: len(data) - n + 1] == owner[n - 1 :])
        value = np.full(len(starts), n, np.uint64)
        for j in range(n):
            value = (value * np.uint64(0x100000001B3)) ^ data[starts + j]
        value ^= value >> np.uint64(29)
        ids.append((value % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[starts])
    ids, owners = np.concatenate(ids), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], owners[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Parameters, and the vocabulary of words that have a vector of their own."""

    words: dict[bytes, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, words: dict[bytes, int], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        made = {
            "word": rng.normal(0, 0.1, (len(words) + 1, WIDTH)),
            "gram": rng.normal(0, 0.1, (BUCKETS, WIDTH)),
            "A": rng.normal(0, 0.3, (2 * HIDDEN, ATTENTION)),
            "a": np.zeros(ATTENTION),
            "v": rng.normal(0, 0.3, ATTENTION),
            "w": rng.normal(0, 0.3, 2 * HIDDEN),
            "c": np.zeros(1),
        }
        made["word"][0] = 0  # words without a vector
        for side in "fb":
            made["W" + side] = rng.normal(0, 0.3, (2 * WIDTH, 3 * HIDDEN))
            made["U" + side] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
            made["d" + side] = np.zeros(3 * HIDDEN)
        return cls(words, {k: v.astype(np.float32) for k, v in made.items()})

    def inputs(self, vocabulary: list[bytes]):
        """Vectors of some words, and what the backward pass needs."""
        ids = np.fromiter((self.words.get(w, 0) for w in vocabulary), np.int64, len(vocabulary))
        grams, owner = gram_ids(vocabulary)
        count = np.bincount(owner, minlength=len(vocabulary)).astype(np.float32)
        starts = np.cumsum(count).astype(np.int64) - count.astype(np.int64)
        chars = np.add.reduceat(self.p["gram"][grams], starts, axis=0) / count[:, None]
        return np.concatenate((self.p["word"][ids], chars), axis=1), (ids, grams, owner, count)

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows: ``at`` has rows of word numbers into ``x``, -1 for padding."""
        p, (count, steps) = self.p, at.shape
        there = at >= 0
        out = np.zeros((count, steps, 2 * HIDDEN), np.float32)
        kept = {}
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            table = x @ p["W" + side] + p["d" + side]
            U, h, saved = p["U" + side], np.zeros((count, HIDDEN), np.float32), []
            lanes = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, 2 * HIDDEN)
            for t in order:
                gates, back = table[at[:, t]], h @ U
                zr = sigmoid(gates[:, : 2 * HIDDEN] + back[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                hn = back[:, 2 * HIDDEN :]
                n = np.tanh(gates[:, 2 * HIDDEN :] + r * hn)
                new = np.where(there[:, t, None], n + z * (h - n), h)
                if keep:
                    saved.append((t, h, z, r, n, hn))
                h = new
                out[:, t, lanes] = h
            kept[side] = saved
        u = np.tanh(out @ p["A"] + p["a"])
        score = np.where(there, u @ p["v"], np.float32(-1e9))
        score -= score.max(axis=1, keepdims=True)
        alpha = np.exp(score) * there
        alpha /= np.maximum(alpha.sum(axis=1, keepdims=True), 1e-9)
        pooled = (alpha[:, None, :] @ out)[:, 0, :]
        logit = pooled @ p["w"] + p["c"][0]
        return (logit, (kept, out, u, alpha, pooled, there)) if keep else logit

    def backward(self, x, at, state, d_logit) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of ``x``."""
        p, (kept, out, u, alpha, pooled, there) = self.p, state
        g = {"w": d_logit @ pooled, "c": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["w"]
        d_out = alpha[:, :, None] * d_pooled[:, None, :]
        d_alpha = (out @ d_pooled[:, :, None])[:, :, 0]
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
        g["v"] = np.tensordot(d_score, u, ((0, 1), (0, 1)))
        d_u = d_score[:, :, None] * p["v"] * (1 - u * u)
        g["A"] = np.tensordot(out, d_u, ((0, 1), (0, 1)))
        g["a"] = d_u.sum(axis=(0, 1))
        d_out += d_u @ p["A"].T
        d_x = np.zeros_like(x)
        for side in "fb":
            U, d_h = p["U" + side], np.zeros((len(at), HIDDEN), np.float32)
            lanes = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, 2 * HIDDEN)
            g_U, g_table = np.zeros_like(U), np.zeros((len(x), 3 * HIDDEN), np.float32)
            for t, h, z, r, n, hn in reversed(kept[side]):
                d_h = d_h + d_out[:, t, lanes]
                live = there[:, t, None].astype(np.float32)
                d_new = d_h * live
                d_n = d_new * (1 - z) * (1 - n * n)
                d_z = d_new * (h - n) * z * (1 - z)
                d_r = d_n * hn * r * (1 - r)
                d_gates = np.concatenate((d_z, d_r, d_n), axis=1)
                d_back = np.concatenate((d_z, d_r, d_n * r), axis=1)
                g_U += h.T @ d_back
                live_rows = at[:, t] >= 0
                np.add.at(g_table, at[live_rows, t], d_gates[live_rows])
                d_h = d_h * (1 - live) + d_new * z + d_back @ U.T
            g["U" + side], g["d" + side] = g_U, g_table.sum(axis=0)
            g["W" + side] = x.T @ g_table
            d_x += g_table @ p["W" + side].T
        return g, d_x


class Adam:
    def __init__(self, rate: float):
        self.rate, self.steps, self.m, self.v = rate, 0, {}, {}

    def update(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for name, grad in g.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0) + 0.1 * grad
            v = self.v[name] = 0.999 * self.v.get(name, 0) + 0.001 * grad * grad
            scale = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
            p[name] -= (scale * m / (np.sqrt(v) + 1e-7)).astype(np.float32)

    def update_rows(self, p: dict[str, np.ndarray], name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        """The same for some rows of a table; rows are distinct."""
        if name not in self.m:
            self.m[name], self.v[name] = np.zeros_like(p[name]), np.zeros_like(p[name])
        m = self.m[name][rows] = 0.9 * self.m[name][rows] + 0.1 * grad
        v = self.v[name][rows] = 0.99 * self.v[name][rows] + 0.01 * grad * grad
        p[name][rows] -= self.rate * m / (np.sqrt(v) + 1e-7)
