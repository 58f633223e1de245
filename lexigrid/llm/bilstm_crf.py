"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    """Tags characters given as small integers; sequences of a batch are equally long."""

    def __init__(self, symbols: int, tags: int, embed: int = 12, hidden: int = 20, seed: int = 0):
        rng = np.random.default_rng(seed)
        scale = lambda *shape: (rng.standard_normal(shape) * np.sqrt(1.0 / shape[0])).astype(np.float32)
        self.hidden = hidden
        self.p = {"embed": scale(symbols, embed) * np.float32(np.sqrt(symbols) * 0.3), "out": scale(2 * hidden, tags), "bias": np.zeros(tags, np.float32), "trans": np.zeros((tags, tags), np.float32), "first": np.zeros(tags, np.float32)}
        for side in "fb":
            self.p["w" + side] = scale(embed + hidden, 4 * hidden)
            self.p["c" + side] = np.zeros(4 * hidden, np.float32)
            self.p["c" + side][hidden : 2 * hidden] = 1  # remember at first
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def _run(self, x: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """Hidden states (time, batch, hidden) in the order of the text."""
        times = range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)
        n = self.hidden
        h = c = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((len(x), x.shape[1], n), np.float32)
        for t in times:
            z = np.concatenate((x[t], h), axis=1)
            a = z @ self.p["w" + side] + self.p["c" + side]
            gates = _sigmoid(a[:, : 3 * n])
            g = np.tanh(a[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep is not None:
                keep.append((t, z, i, f, o, g, before, tc))
        return out

    def scores(self, symbols: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Emission scores (time, batch, tags) of symbols (batch, time)."""
        x = self.p["embed"][symbols.T]
        tapes: dict[str, list | None] = {s: [] if keep is not None else None for s in "fb"}
        h = np.concatenate([self._run(x, s, tapes[s]) for s in "fb"], axis=2)
        if keep is not None:
            keep.update(tapes=tapes, h=h)
        return h @ self.p["out"] + self.p["bias"]

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        """The best path (batch, time) of each sequence, by Viterbi."""
        e = self.scores(symbols)
        best, back = e[0] + self.p["first"], []
        for t in range(1, len(e)):
            reach = best[:, :, None] + self.p["trans"][None]
            back.append(reach.argmax(axis=1))
            best = reach.max(axis=1) + e[t]
        path = [best.argmax(axis=1)]
        for b in reversed(back):
            path.append(b[np.arange(len(path[-1])), path[-1]])
        return np.stack(path[::-1], axis=1)

    def gradients(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of the tags, and its gradient by each parameter."""
        keep: dict = {}
        e = self.scores(symbols, keep).astype(np.float64)
        steps, batch, k = e.shape
        y, rows = tags.T, np.arange(batch)
        trans, first = self.p["trans"].astype(np.float64), self.p["first"].astype(np.float64)
        ahead = np.empty_like(e)
        ahead[0] = first + e[0]
        for t in range(1, steps):
            ahead[t] = _logsumexp(ahead[t - 1][:, :, None] + trans[None], 1) + e[t]
        whole = _logsumexp(ahead[-1], 1)
        behind = np.zeros_like(e)
        d_trans = np.zeros_like(trans)
        for t in range(steps - 2, -1, -1):
            onward = trans[None] + (e[t + 1] + behind[t + 1])[:, None, :]
            behind[t] = _logsumexp(onward, 2)
            d_trans += np.exp(ahead[t][:, :, None] + onward - whole[:, None, None]).sum(axis=0)
        np.subtract.at(d_trans, (y[:-1].ravel(), y[1:].ravel()), 1)
        gold = first[y[0]] + e[np.arange(steps)[:, None], rows, y].sum(axis=0) + trans[y[:-1], y[1:]].sum(axis=0)
        d_e = np.exp(ahead + behind - whole[None, :, None])
        d_e[np.arange(steps)[:, None], rows, y] -= 1
        scale = 1.0 / batch
        grads = {"trans": d_trans * scale, "first": d_e[0].sum(axis=0) * scale}
        d_e = (d_e * scale).astype(np.float32)
        grads["out"] = np.tensordot(keep["h"], d_e, axes=([0, 1], [0, 1]))
        grads["bias"] = d_e.sum(axis=(0, 1))
        d_h = d_e @ self.p["out"].T
        n = self.hidden
        d_x = np.zeros((steps, batch, self.p["embed"].shape[1]), np.float32)
        for s, half in (("f", d_h[:, :, :n]), ("b", d_h[:, :, n:])):
            w = self.p["w" + s]
            d_w, d_c0 = np.zeros_like(w), np.zeros_like(self.p["c" + s])
            next_h = next_c = np.zeros((batch, n), np.float32)
            for t, z, i, f, o, g, before, tc in reversed(keep["tapes"][s]):
                dh = half[t] + next_h
                dc = next_c + dh * o * (1 - tc * tc)
                da = np.concatenate((dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
                d_w += z.T @ da
                d_c0 += da.sum(axis=0)
                dz = da @ w.T
                d_x[t] += dz[:, :-n]
                next_h, next_c = dz[:, -n:], dc * f
            grads["w" + s], grads["c" + s] = d_w, d_c0
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], symbols.T, d_x)
        return float((whole - gold).mean()), grads

    def train(self, symbols: np.ndarray, tags: np.ndarray, rate: float = 0.01) -> float:
        """One Adam step on the mean negative log-likelihood of the tags; returns it."""
        loss, grads = self.gradients(symbols, tags)
        self.steps += 1
        for name, grad in grads.items():
            grad = np.clip(grad, -5, 5).astype(np.float32)
            m, v = self.moments[name]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            self.p[name] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)
        return loss
