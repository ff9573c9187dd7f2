"""A small bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a position are a learned word vector and the sum of learned character trigram vectors.
Two gated recurrent layers read a window from both ends, attention weighs their states, and a
logistic unit gives the window's log odds. Gradients are written out; training is Adam.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Params = dict[str, np.ndarray]


@dataclass
class Windows:
    """Windows as word numbers (windows, length; -1 beyond the end) and trigrams per place.

    `grams` are the trigram numbers of all places one after the other, `bounds` where each place
    begins (one more than places), both in the order of the flattened words.
    """

    words: np.ndarray
    grams: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.words)

    def take(self, index: np.ndarray) -> Windows:
        places = (np.asarray(index)[:, None] * self.words.shape[1] + np.arange(self.words.shape[1])).ravel()
        begin, size = self.bounds[places], np.diff(self.bounds)[places]
        bounds = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(bounds[-1]) - np.repeat(bounds[:-1], size)
        return Windows(self.words[index], self.grams[np.repeat(begin, size) + inside], bounds)


def initial(words: int, grams: int, inputs: int, hidden: int, seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)

    def some(*shape: int, size: float) -> np.ndarray:
        return rng.normal(scale=size, size=shape).astype(np.float32)

    p = {"word": some(words, inputs, size=0.1), "gram": some(grams, inputs, size=0.05)}
    for d in ("f", "b"):
        p[f"W{d}"] = some(2 * inputs, 3 * hidden, size=(2 * inputs) ** -0.5)
        p[f"U{d}"] = some(hidden, 3 * hidden, size=hidden**-0.5)
        p[f"c{d}"] = np.zeros(3 * hidden, np.float32)
    p["A"] = some(2 * hidden, hidden, size=(2 * hidden) ** -0.5)
    p["a"] = np.zeros(hidden, np.float32)
    p["v"] = some(hidden, size=hidden**-0.5)
    p["o"] = some(2 * hidden, size=(2 * hidden) ** -0.5)
    p["bias"] = np.zeros(1, np.float32)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _place_inputs(p: Params, w: Windows) -> np.ndarray:
    """(places, 2 * inputs): word vector beside the sum of trigram vectors."""
    flat = w.words.ravel()
    chars = np.zeros((len(flat), p["gram"].shape[1]), p["gram"].dtype)
    full = np.diff(w.bounds) > 0
    if full.any():
        chars[full] = np.add.reduceat(p["gram"][w.grams], w.bounds[:-1][full], axis=0)
    return np.concatenate([p["word"][np.maximum(flat, 0)], chars], axis=1)


def _direction(p: Params, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States (length, windows, hidden) of one layer; x is (length, windows, 3 * hidden)."""
    length, n, _ = x.shape
    u = p[f"U{d}"]
    size = u.shape[0]
    h = np.zeros((n, size), x.dtype)
    out = np.empty((length, n, size), x.dtype)
    steps = range(length) if d == "f" else range(length - 1, -1, -1)
    for t in steps:
        s = h @ u
        g = _sigmoid(x[t, :, : 2 * size] + s[:, : 2 * size])
        z, r, sn = g[:, :size], g[:, size:], s[:, 2 * size :]
        c = np.tanh(x[t, :, 2 * size :] + r * sn)
        new = c + z * (h - c)
        m = mask[t]
        if keep is not None:
            keep.append((t, h, z, r, sn, c))
        h = h + m * (new - h)
        out[t] = h
    return out


def log_odds(p: Params, w: Windows, keep: dict | None = None) -> np.ndarray:
    """Log odds of each window; a window without words gets the bias alone."""
    n, length = w.words.shape
    mask = (w.words >= 0).T[:, :, None].astype(p["bias"].dtype)
    x = _place_inputs(p, w)
    states, saved = [], {}
    for d in ("f", "b"):
        projected = (x @ p[f"W{d}"] + p[f"c{d}"]).reshape(n, length, -1).swapaxes(0, 1)
        saved[d] = [] if keep is not None else None
        states.append(_direction(p, d, np.ascontiguousarray(projected), mask, saved[d]))
    h = np.concatenate(states, axis=2)
    e = np.tanh(h @ p["A"] + p["a"])
    score = (e @ p["v"])[:, :, None] - 1e4 * (1 - mask)
    weight = np.exp(score - score.max(axis=0)) * mask
    weight /= np.maximum(weight.sum(axis=0), 1e-30)
    pooled = (weight * h).sum(axis=0)
    if keep is not None:
        keep.update(x=x, mask=mask, steps=saved, h=h, e=e, weight=weight, pooled=pooled)
    return pooled @ p["o"] + p["bias"][0]


def gradients(p: Params, w: Windows, target: np.ndarray) -> tuple[float, Params]:
    """Mean logistic loss and its gradient for all parameters."""
    k: dict = {}
    odds = log_odds(p, w, k)
    n, length = w.words.shape
    loss = float(np.mean(np.logaddexp(0, odds) - target * odds))
    g = {name: np.zeros_like(x) for name, x in p.items()}
    d_odds = ((_sigmoid(odds) - target) / n).astype(odds.dtype)
    g["o"], g["bias"] = k["pooled"].T @ d_odds, np.array([d_odds.sum()], odds.dtype)
    d_pooled = d_odds[:, None] * p["o"]
    d_weight = (d_pooled * k["h"]).sum(axis=2, keepdims=True)
    d_h = k["weight"] * d_pooled
    d_score = k["weight"] * (d_weight - (k["weight"] * d_weight).sum(axis=0))
    g["v"] = (d_score * k["e"]).sum(axis=(0, 1))
    d_e = d_score * p["v"] * (1 - k["e"] ** 2)
    g["A"] = np.einsum("tni,tnj->ij", k["h"], d_e)
    g["a"] = d_e.sum(axis=(0, 1))
    d_h = d_h + d_e @ p["A"].T
    d_x = np.zeros_like(k["x"])
    size = p["Uf"].shape[0]
    for i, d in enumerate(("f", "b")):
        u, back = p[f"U{d}"], d_h[:, :, i * size : (i + 1) * size]
        d_in = np.zeros((length, n, 3 * size), odds.dtype)
        carry = np.zeros((n, size), odds.dtype)
        for t, h, z, r, sn, c in reversed(k["steps"][d]):
            m = k["mask"][t]
            total = back[t] + carry
            d_new = m * total
            d_c = d_new * (1 - z) * (1 - c**2)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * sn * r * (1 - r)
            d_s = np.concatenate([d_z, d_r, d_c * r], axis=1)
            g[f"U{d}"] += h.T @ d_s
            d_in[t] = np.concatenate([d_z, d_r, d_c], axis=1)
            carry = (1 - m) * total + d_new * z + d_s @ u.T
        flat = d_in.swapaxes(0, 1).reshape(n * length, -1)
        g[f"W{d}"] = k["x"].T @ flat
        g[f"c{d}"] = flat.sum(axis=0)
        d_x += flat @ p[f"W{d}"].T
    inputs = p["word"].shape[1]
    np.add.at(g["word"], np.maximum(w.words.ravel(), 0), d_x[:, :inputs])
    np.add.at(g["gram"], w.grams, np.repeat(d_x[:, inputs:], np.diff(w.bounds), axis=0))
    return loss, g


class Adam:
    def __init__(self, p: Params, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {n: np.zeros_like(x) for n, x in p.items()}
        self.s = {n: np.zeros_like(x) for n, x in p.items()}

    def step(self, g: Params) -> None:
        self.t += 1
        norm = float(np.sqrt(sum((x.astype(np.float64) ** 2).sum() for x in g.values())))
        for n, x in g.items():
            x = x * min(1.0, 5.0 / max(norm, 1e-9))
            self.m[n] += 0.1 * (x - self.m[n])
            self.s[n] += 0.001 * (x * x - self.s[n])
            m, s = self.m[n] / (1 - 0.9**self.t), self.s[n] / (1 - 0.999**self.t)
            self.p[n] -= self.rate * m / (np.sqrt(s) + 1e-8)
