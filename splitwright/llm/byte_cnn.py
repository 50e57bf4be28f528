"""A byte convolutional network in numpy: embeddings, filters of several widths, max pooling, softmax."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

WINDOW = 64
WIDTHS = (2, 3, 4, 5)
FILTERS = 40
EMBEDDING = 16


@dataclass
class ByteCNN:
    """Classifies windows of ``window`` bytes (0 pads); weights are plain float32 arrays."""

    classes: tuple[str, ...]
    window: int = WINDOW
    widths: tuple[int, ...] = WIDTHS
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, classes: tuple[str, ...], seed: int = 0, filters: int = FILTERS, embedding: int = EMBEDDING) -> "ByteCNN":
        rng = np.random.default_rng(seed)
        net = cls(classes)
        w = {"embed": rng.normal(0, 0.5, (256, embedding))}
        w["embed"][0] = 0
        for k in net.widths:
            w[f"conv{k}"] = rng.normal(0, (k * embedding) ** -0.5, (k * embedding, filters))
            w[f"bias{k}"] = np.zeros(filters)
        w["out"] = rng.normal(0, (len(net.widths) * filters) ** -0.5, (len(net.widths) * filters, len(classes)))
        w["out_bias"] = np.zeros(len(classes))
        net.weights = {k: v.astype(np.float32) for k, v in w.items()}
        return net

    def _features(self, x: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        w = self.weights
        e = w["embed"][x]
        n, length, d = e.shape
        pooled, kept = [], []
        for k in self.widths:
            at = np.lib.stride_tricks.as_strided(e, (n, length - k + 1, k * d), (e.strides[0], e.strides[1], e.strides[2]))
            h = at.reshape(-1, k * d) @ w[f"conv{k}"]
            h = h.reshape(n, length - k + 1, -1)
            where = h.argmax(1)
            top = np.take_along_axis(h, where[:, None, :], 1)[:, 0] + w[f"bias{k}"]
            pooled.append(np.maximum(top, 0))
            kept.append((where, at))
        return np.concatenate(pooled, 1), kept

    def log_probabilities(self, x: np.ndarray, batch: int = 16) -> np.ndarray:
        """Of each window and class.

        All filters, padded to the widest, are one matrix. Places lead and windows follow, so that pooling runs over whole rows; a batch stays in
        the cache.
        """
        w, out = self.weights, []
        d, wide = w["embed"].shape[1], max(self.widths)
        filters = w["out"].shape[0] // len(self.widths)
        matrix = np.zeros((wide * d, filters * len(self.widths)), w["out"].dtype)
        for i, k in enumerate(self.widths):
            matrix[: k * d, i * filters : (i + 1) * filters] = w[f"conv{k}"]
        bias = np.concatenate([w[f"bias{k}"] for k in self.widths])
        for b in range(0, len(x), batch):
            t = x[b : b + batch].T
            length, n = t.shape
            e = np.zeros((length + wide - 1, n, d), w["embed"].dtype)
            e[:length] = w["embed"][t]
            h = (np.concatenate([e[o : o + length] for o in range(wide)], 2).reshape(-1, wide * d) @ matrix).reshape(length, n, -1)
            top = np.concatenate([h[: length - k + 1, :, i * filters : (i + 1) * filters].max(0) for i, k in enumerate(self.widths)], 1)
            z = np.maximum(top + bias, 0) @ w["out"] + w["out_bias"]
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 0, rate: float = 2e-3, batch: int = 64) -> None:
        """Adam on the mean cross entropy; every class weighs the same."""
        rng = np.random.default_rng(seed)
        w = self.weights
        counts = np.bincount(y, minlength=len(self.classes)).astype(float)
        weigh = (counts.sum() / np.maximum(counts, 1) / max(1, (counts > 0).sum())) ** 0.5
        m = {k: np.zeros_like(v) for k, v in w.items()}
        s = {k: np.zeros_like(v) for k, v in w.items()}
        step, total = 0, epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for b in range(0, len(order), batch):
                pick = order[b : b + batch]
                grads = self._gradients(x[pick], y[pick], weigh[y[pick]], rng)
                step += 1
                lr = rate * (1 - step / (total + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    w[k] -= (lr * m[k] / (np.sqrt(s[k]) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weigh: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        w = self.weights
        f, kept = self._features(x)
        drop = (rng.random(f.shape) > 0.25).astype(np.float32) / 0.75
        fd = f * drop
        z = fd @ w["out"] + w["out_bias"]
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= (weigh / len(y))[:, None].astype(np.float32)
        grads = {"out": fd.T @ p, "out_bias": p.sum(0)}
        gf = (p @ w["out"].T) * drop * (f > 0)
        ge = np.zeros_like(w["embed"])
        at = 0
        for k, (where, windows) in zip(self.widths, kept):
            c = w[f"conv{k}"]
            g = gf[:, at : at + c.shape[1]]
            at += c.shape[1]
            rows = np.arange(len(x))[:, None]
            seen = windows[rows, where]
            grads[f"conv{k}"] = np.einsum("bfi,bf->if", seen, g, optimize=True)
            grads[f"bias{k}"] = g.sum(0)
            back = (g[:, :, None] * c.T[None]).reshape(*g.shape, k, -1)
            for o in range(k):
                np.add.at(ge, x[rows, where + o], back[:, :, o])
        ge[0] = 0
        grads["embed"] = ge
        return grads


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """Windows of ``size`` bytes over the data, the last one flush with its end; short data is one window."""
    if len(data) <= size:
        return [data]
    starts = [*range(0, len(data) - size, size), len(data) - size]
    return [data[a : a + size] for a in starts]


def as_array(parts: list[bytes], size: int = WINDOW) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(size, b"\0") for p in parts), np.uint8).reshape(-1, size)
