"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, window scores and decoding.

Both directions run as one batched step; training is plain back-propagation through time with Adam.
"""

from __future__ import annotations

import numpy as np

CLASSES = 100  # 0: outside the text; 1..95: printable ASCII; 96: white space; 97: other letter; 98: other


def classes_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    out = np.where((code >= 32) & (code < 127), code - 31, np.where(code < 33, 96, np.where(code >= 0xC0, 97, 98)))
    return out.astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


class Tagger:
    def __init__(self, tags: int, embed: int = 12, hidden: int = 20, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden

        def draw(*shape: int) -> np.ndarray:
            return rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)

        self.w = {
            "embed": rng.normal(0, 0.5, (CLASSES, embed)).astype(np.float32),
            "x": draw(2, embed, 4 * hidden), "h": draw(2, hidden, 4 * hidden), "b": np.zeros((2, 1, 4 * hidden), np.float32),
            "out": draw(2 * hidden, tags), "ob": np.zeros(tags, np.float32), "step": np.zeros((tags, tags), np.float32),
        }
        self.w["b"][:, :, hidden : 2 * hidden] = 1.0  # forget gates start open

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """x: windows x length classes -> windows x length x tags scores. The second direction reads backwards."""
        w, n, length, k = self.w, len(x), x.shape[1], self.hidden
        both = np.stack([w["embed"][x], w["embed"][x[:, ::-1]]])
        drive = np.matmul(both.reshape(2, n * length, -1), w["x"]).reshape(2, n, length, 4 * k) + w["b"][:, :, None]
        h = np.zeros((2, length + 1, n, k), np.float32)
        c = np.zeros_like(h)
        gates = np.zeros((2, length, n, 4 * k), np.float32)
        for t in range(length):
            g = drive[:, :, t] + np.matmul(h[:, t], w["h"])
            g[..., : 3 * k] = _sigmoid(g[..., : 3 * k])
            g[..., 3 * k :] = np.tanh(g[..., 3 * k :])
            gates[:, t] = g
            c[:, t + 1] = g[..., k : 2 * k] * c[:, t] + g[..., :k] * g[..., 3 * k :]
            h[:, t + 1] = g[..., 2 * k : 3 * k] * np.tanh(c[:, t + 1])
        out = np.concatenate((h[0, 1:].transpose(1, 0, 2), h[1, 1:][::-1].transpose(1, 0, 2)), axis=2)
        return out @ w["out"] + w["ob"], {"x": x, "both": both, "h": h, "c": c, "gates": gates, "out": out}

    def backward(self, seen: dict, d: np.ndarray) -> dict[str, np.ndarray]:
        w, k = self.w, self.hidden
        n, length = seen["x"].shape
        grad = {"out": np.einsum("nti,ntj->ij", seen["out"], d), "ob": d.sum((0, 1))}
        dout = d @ w["out"].T
        dh_at = np.stack([dout[:, :, :k].transpose(1, 0, 2), dout[:, ::-1, k:].transpose(1, 0, 2)])
        dh, dc = np.zeros((2, n, k), np.float32), np.zeros((2, n, k), np.float32)
        dg_at = np.zeros((2, length, n, 4 * k), np.float32)
        back = w["h"].transpose(0, 2, 1)
        for t in range(length - 1, -1, -1):
            dh = dh + dh_at[:, t]
            g, c = seen["gates"][:, t], np.tanh(seen["c"][:, t + 1])
            i, f, o, u = (g[..., s * k : (s + 1) * k] for s in range(4))
            dc = dc + dh * o * (1 - c * c)
            dg = dg_at[:, t]
            dg[..., :k] = dc * u * i * (1 - i)
            dg[..., k : 2 * k] = dc * seen["c"][:, t] * f * (1 - f)
            dg[..., 2 * k : 3 * k] = dh * c * o * (1 - o)
            dg[..., 3 * k :] = dc * i * (1 - u * u)
            dc = dc * f
            dh = np.matmul(dg, back)
        flat = dg_at.reshape(2, length * n, 4 * k)
        grad["h"] = np.matmul(seen["h"][:, :-1].reshape(2, length * n, k).transpose(0, 2, 1), flat)
        grad["b"] = flat.sum(1, keepdims=True)
        both = seen["both"].transpose(0, 2, 1, 3).reshape(2, length * n, -1)
        grad["x"] = np.matmul(both.transpose(0, 2, 1), flat)
        de = np.matmul(flat, w["x"].transpose(0, 2, 1)).reshape(2, length, n, -1)
        grad["embed"] = np.zeros_like(w["embed"])
        np.add.at(grad["embed"], seen["x"].T, de[0])
        np.add.at(grad["embed"], seen["x"][:, ::-1].T, de[1])
        return grad

    def crf(self, scores: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log likelihood of y, and its gradients by the scores and the transitions."""
        n, length, _ = scores.shape
        step = self.w["step"].astype(np.float64)
        s = scores.astype(np.float64)

        def add(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))

        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for t in range(1, length):
            alpha[:, t] = s[:, t] + add(alpha[:, t - 1, :, None] + step, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = add(step[None] + (s[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        total = add(alpha[:, -1], 1)
        p = np.exp(alpha + beta - total[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + step + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum((0, 1))
        rows, cols = np.arange(n)[:, None], np.arange(length)[None]
        gold = s[rows, cols, y].sum() + step[y[:, :-1], y[:, 1:]].sum()
        np.subtract.at(pair, (y[:, :-1], y[:, 1:]), 1.0)
        p[rows, cols, y] -= 1.0
        return (total.sum() - gold) / n, (p / n).astype(np.float32), (pair / n).astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 48, rate: float = 0.02, seed: int = 11) -> list[float]:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(v) for k, v in self.w.items()}
        losses = []
        for step in range(1, steps + 1):
            at = rng.integers(0, len(x), min(batch, 4 * len(x)))
            scores, seen = self.forward(x[at])
            loss, d, dstep = self.crf(scores, y[at])
            grad = self.backward(seen, d) | {"step": dstep}
            norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grad.values()))
            now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] = (self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(float(loss))
        return losses

    def certain(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of sequences of one length, and each tag's posterior under the transitions."""
        best = self.decode(scores)
        s, step = scores.astype(np.float64), np.exp(self.w["step"].astype(np.float64))
        n, length, _ = s.shape
        up = np.exp(s - s.max(2, keepdims=True))
        alpha, beta = np.zeros_like(up), np.ones_like(up)
        alpha[:, 0] = up[:, 0] / up[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            a = up[:, t] * (alpha[:, t - 1] @ step)
            alpha[:, t] = a / a.sum(1, keepdims=True)
        for t in range(length - 2, -1, -1):
            b = (up[:, t + 1] * beta[:, t + 1]) @ step.T
            beta[:, t] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        return best, np.take_along_axis(p, best[:, :, None], 2)[:, :, 0]

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best tags of sequences of one length."""
        n, length, tags = scores.shape
        best, back = scores[:, 0].astype(np.float64), np.zeros((n, length, tags), np.int16)
        for t in range(1, length):
            way = best[:, :, None] + self.w["step"]
            back[:, t] = way.argmax(1)
            best = way.max(1) + scores[:, t]
        out = np.zeros((n, length), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[np.arange(n), t, out[:, t]]
        return out
