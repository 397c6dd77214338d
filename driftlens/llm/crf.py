"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Windows are arrays of character classes, shape (batch, length); tags are integers. Forward and backward layers run
over the whole batch a step at a time; the loss is the CRF's negative log-likelihood, and its gradient is carried
back through time.
"""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, classes: int, tags: int, embed: int = 12, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden, self.tags = hidden, tags
        self.p = {"embed": draw(classes, embed) * np.float32(np.sqrt(classes) * 0.3), "out": draw(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32), "start": np.zeros(tags, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(embed + hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
            self.p[f"c{d}"][hidden : 2 * hidden] = 1  # remember at first

    def _lstm(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        w, c, k = self.p[f"w{d}"], self.p[f"c{d}"], self.hidden
        n, length, e = x.shape
        fed = x @ w[:e] + c
        h, cell, out, trail = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32), np.empty((n, length, k), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = fed[:, t] + h @ w[e:]
            gates = _sigmoid(z[:, : 3 * k])
            i, f, o, g = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :], np.tanh(z[:, 3 * k :])
            before, last = cell, h
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            h = o * squashed
            out[:, t] = h
            if keep:
                trail.append((t, i, f, o, g, before, squashed, last))
        return out, trail

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """Emission scores (batch, length, tags)."""
        x = self.p["embed"][windows]
        both = np.concatenate((self._lstm(x, "f", False)[0], self._lstm(x, "b", False)[0]), axis=2)
        return both @ self.p["out"] + self.p["bias"]

    def gradient(self, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a batch, and its gradient."""
        p, k = self.p, self.hidden
        n, length = windows.shape
        x = p["embed"][windows]
        (f, trail_f), (b, trail_b) = self._lstm(x, "f", True), self._lstm(x, "b", True)
        both = np.concatenate((f, b), axis=2)
        score = both @ p["out"] + p["bias"]
        alpha, beta = np.empty_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0] + p["start"]
        for t in range(1, length):
            alpha[:, t] = _sum(alpha[:, t - 1, :, None] + p["trans"], 1) + score[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _sum(p["trans"] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        whole = _sum(alpha[:, -1], 1)
        d_score = np.exp(alpha + beta - whole[:, None, None])
        rows, steps = np.arange(n)[:, None], np.arange(length)[None, :]
        gold = score[rows, steps, tags].sum(1) + p["start"][tags[:, 0]] + p["trans"][tags[:, :-1], tags[:, 1:]].sum(1)
        grad = {key: np.zeros_like(v) for key, v in p.items()}
        pair = np.zeros_like(p["trans"], dtype=np.float64)
        for t in range(1, length):
            pair += np.exp(alpha[:, t - 1, :, None] + p["trans"] + (score[:, t] + beta[:, t])[:, None, :] - whole[:, None, None]).sum(0)
        np.add.at(pair, (tags[:, :-1], tags[:, 1:]), -1)
        d_score[rows, steps, tags] -= 1
        d_score /= n
        grad["trans"], grad["start"] = (pair / n).astype(np.float32), d_score[:, 0].sum(0)
        grad["bias"], grad["out"] = d_score.sum((0, 1)), both.reshape(-1, 2 * k).T @ d_score.reshape(-1, self.tags)
        d_both, d_x = d_score @ p["out"].T, np.zeros_like(x)
        for d, trail, d_out in (("f", trail_f, d_both[:, :, :k]), ("b", trail_b, d_both[:, :, k:])):
            w, e = p[f"w{d}"], x.shape[2]
            d_h, d_cell, d_w = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32), grad[f"w{d}"]
            for t, i, f, o, g, before, squashed, last in reversed(trail):
                d_h = d_h + d_out[:, t]
                d_cell = d_cell + d_h * o * (1 - squashed**2)
                d_z = np.concatenate((d_cell * g * i * (1 - i), d_cell * before * f * (1 - f), d_h * squashed * o * (1 - o), d_cell * i * (1 - g**2)), axis=1)
                d_w[:e] += x[:, t].T @ d_z
                d_w[e:] += last.T @ d_z
                grad[f"c{d}"] += d_z.sum(0)
                d_x[:, t] += d_z @ w[:e].T
                d_h, d_cell = d_z @ w[e:].T, d_cell * f
        np.add.at(grad["embed"], windows, d_x)
        return float((whole - gold).mean()), grad

    def train(self, windows: np.ndarray, tags: np.ndarray, rounds: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Tagger:
        """Adam over shuffled batches, with a falling rate."""
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        for r in range(rounds):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                _, grad = self.gradient(windows[order[at : at + batch]], tags[order[at : at + batch]])
                step += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                for k, g in grad.items():
                    g = g * min(1.0, 5 / max(norm, 1e-9))
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (rate * (1 - r / (rounds + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tag sequence (Viterbi) for each sequence of emission scores (length, tags); all go side by side."""
        p, ends = self.p, np.array([len(s) for s in scores]) - 1
        n, length, rows = len(scores), int(ends.max()) + 1, np.arange(len(scores))
        score = np.zeros((length, n, self.tags), np.float32)
        for i, s in enumerate(scores):
            score[: len(s), i] = s
        back, last = np.zeros(score.shape, dtype=np.int8), np.zeros(n, dtype=np.int8)
        best = score[0] + p["start"]
        last[ends == 0] = best.argmax(1)[ends == 0]
        for t in range(1, length):
            step = best[:, :, None] + p["trans"]
            back[t] = step.argmax(1)
            best = step.max(1) + score[t]
            if (over := ends == t).any():
                last[over] = best[over].argmax(1)
        out = np.zeros((length, n), dtype=np.int8)
        for t in range(length - 1, -1, -1):
            out[t] = np.where(ends == t, last, back[t + 1][rows, out[t + 1]] if t + 1 < length else last)
        return [out[: e + 1, i] for i, e in enumerate(ends.tolist())]
