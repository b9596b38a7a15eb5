"""A character-level bidirectional LSTM with CRF transitions, in NumPy.

Windows of characters are rows of small integers, 0 beyond their end. Training is by Adam on the negative
log-likelihood of the tag sequence; the same seed and windows give the same model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: ASCII characters stand for themselves; all others are one.
SYMBOLS = 129
PAD = 0


def symbols(text: str) -> np.ndarray:
    """The symbols of a text, by code points."""
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), SYMBOLS - 1).astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Tagger:
    """Weights by name; ``tags`` many tags, tag 0 for what is no span."""

    weights: dict[str, np.ndarray]
    tags: int

    @classmethod
    def new(cls, tags: int, hidden: int = 20, seed: int = 12) -> Tagger:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {}
        for way in ("f", "b"):
            w[f"in_{way}"] = rng.normal(0, 0.3, (SYMBOLS, 4 * hidden))  # embedding and input weights in one
            w[f"re_{way}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            w[f"bias_{way}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        w["out"] = rng.normal(0, 0.3, (2 * hidden, tags))
        w["out_bias"] = np.zeros(tags)
        w["moves"] = np.zeros((tags, tags))
        w["first"] = np.zeros(tags)
        return cls({k: v.astype(np.float32) for k, v in w.items()}, tags)

    def _lstm(self, x: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States (time, row, hidden). Beyond a window's end the state stays as it is, so both ways start at real text."""
        w_in, w_re, bias = (self.weights[f"{k}_{way}"] for k in ("in", "re", "bias"))
        hidden = len(w_re)
        h, c = np.zeros((2, x.shape[0], hidden), np.float32)
        out = np.empty((x.shape[1], x.shape[0], hidden), np.float32)
        for t in range(x.shape[1]) if way == "f" else reversed(range(x.shape[1])):
            z = w_in[x[:, t]] + h @ w_re + bias
            gates = _sigmoid(z[:, : 3 * hidden])
            i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
            g = np.tanh(z[:, 3 * hidden :])
            real = (x[:, t] != PAD)[:, None]
            new_c = np.where(real, f * c + i * g, c)
            tanh_c = np.tanh(new_c)
            new_h = np.where(real, o * tanh_c, h)
            if keep is not None:
                keep.append((t, i, f, o, g, c, h, tanh_c, real))
            h, c = new_h, new_c
            out[t] = h
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores (time, row, tag)."""
        steps: dict[str, list | None] = {"f": None, "b": None} if keep is None else {"f": [], "b": []}
        states = np.concatenate([self._lstm(x, way, steps[way]) for way in ("f", "b")], axis=2)
        if keep is not None:
            keep.update(steps, states=states)
        return states @ self.weights["out"] + self.weights["out_bias"]

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood a window and its gradients; y is 0 beyond a window's end."""
        keep: dict = {}
        e = self.emissions(x, keep).astype(np.float64)
        moves, first = (self.weights[k].astype(np.float64) for k in ("moves", "first"))
        n, rows = len(e), np.arange(x.shape[0])
        real = (x != PAD).T
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = first + e[0]
        for t in range(1, n):
            step = _log_sum(alpha[t - 1][:, :, None] + moves, 1) + e[t]
            alpha[t] = np.where(real[t][:, None], step, alpha[t - 1])
        for t in reversed(range(n - 1)):
            step = _log_sum(moves + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(real[t + 1][:, None], step, beta[t + 1])
        total = _log_sum(alpha[-1], 1)
        gold = first[y[:, 0]] + e[0, rows, y[:, 0]]
        d_e = np.exp(alpha + beta - total[:, None]) * real[:, :, None]
        d_first, d_moves = d_e[0].copy(), np.zeros_like(moves)
        d_first[rows, y[:, 0]] -= 1
        for t in range(n):
            d_e[t, rows, y[:, t]] -= real[t]
            if t:
                gold += real[t] * (e[t, rows, y[:, t]] + moves[y[:, t - 1], y[:, t]])
                pair = np.exp(alpha[t - 1][:, :, None] + moves + (e[t] + beta[t])[:, None, :] - total[:, None, None])
                d_moves += (pair * real[t][:, None, None]).sum(0)
                np.subtract.at(d_moves, (y[:, t - 1], y[:, t]), real[t].astype(float))
        scale = 1 / len(rows)
        grads = {"moves": d_moves * scale, "first": d_first.sum(0) * scale}
        self._backward(x, (d_e * scale).astype(np.float32), keep, grads)
        return float((total - gold).mean()), grads

    def _backward(self, x: np.ndarray, d_e: np.ndarray, keep: dict, grads: dict) -> None:
        flat = d_e.reshape(-1, self.tags)
        grads["out"] = keep["states"].reshape(len(flat), -1).T @ flat
        grads["out_bias"] = flat.sum(0)
        d_states = d_e @ self.weights["out"].T
        hidden = d_states.shape[2] // 2
        for way, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
            w_re = self.weights[f"re_{way}"]
            d_re, d_all = np.zeros_like(w_re), np.empty((x.shape[1], x.shape[0], w_re.shape[1]), np.float32)
            d_h, d_c = np.zeros((2, x.shape[0], hidden), np.float32)
            for t, i, f, o, g, c, h, tanh_c, real in reversed(keep[way]):
                d_h = d_h + d_states[t][:, part]
                own_h, own_c = d_h * real, d_c * real
                d_cell = own_c + own_h * o * (1 - tanh_c**2)
                d_z = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), own_h * tanh_c * o * (1 - o), d_cell * i * (1 - g**2)], 1)
                d_all[t] = d_z
                d_re += h.T @ d_z
                d_h, d_c = d_h * ~real + d_z @ w_re.T, d_c * ~real + d_cell * f
            d_all = d_all.reshape(-1, w_re.shape[1])
            which = x.T.ravel()[:, None] == np.arange(SYMBOLS)
            grads[f"in_{way}"], grads[f"re_{way}"], grads[f"bias_{way}"] = which.T.astype(np.float32) @ d_all, d_re, d_all.sum(0)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.02, seed: int = 12) -> list[float]:
        """Adam, the rate falling to a tenth; returns the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        mean = {k: np.zeros_like(v) for k, v in self.weights.items()}
        square = {k: np.zeros_like(v) for k, v in self.weights.items()}
        steps = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, sums = rng.permutation(len(x)), 0.0
            for lo in range(0, len(x), batch):
                rows = order[lo : lo + batch]
                loss, grads = self.loss(x[rows], y[rows])
                sums += loss * len(rows)
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                step += 1
                now = rate * 0.1 ** (step / steps)
                for k, g in grads.items():
                    g = (g * min(1.0, 5 / (norm + 1e-9))).astype(np.float32)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g**2
                    self.weights[k] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(sums / len(x))
        return losses

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tag sequence of each window (row, time), and how far each tag's emission is above tag 0's."""
        e = self.emissions(x)
        n, rows = len(e), np.arange(x.shape[0])
        best = self.weights["first"] + e[0]
        back = np.empty(e.shape, np.int8)
        for t in range(1, n):
            ways = best[:, :, None] + self.weights["moves"]
            back[t] = ways.argmax(1)
            real = (x[:, t] != PAD)[:, None]
            back[t] = np.where(real, back[t], np.arange(self.tags))
            best = np.where(real, ways.max(1) + e[t], best)
        tags = np.empty(x.shape, np.int64)
        tags[:, -1] = best.argmax(1)
        for t in reversed(range(1, n)):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        tags[x == PAD] = 0
        margin = np.take_along_axis(e, tags.T[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        return tags, margin.T
