"""A bidirectional LSTM in numpy: forward pass, back-propagation through time, and Adam."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


class Soft:
    """Logistic gates and tanh; slopes are functions of the values."""

    @staticmethod
    def gate(x: np.ndarray) -> np.ndarray:
        return _sigmoid(x)

    @staticmethod
    def gate_slope(y: np.ndarray) -> np.ndarray:
        return y * (1 - y)

    @staticmethod
    def cell(x: np.ndarray) -> np.ndarray:
        return np.tanh(x)

    @staticmethod
    def cell_slope(y: np.ndarray) -> np.ndarray:
        return 1 - y**2


class Hard:
    """Straight lines cut off at their ends in place of the curves: no exponentials."""

    @staticmethod
    def gate(x: np.ndarray) -> np.ndarray:
        return np.clip(0.25 * x + 0.5, 0, 1)

    @staticmethod
    def gate_slope(y: np.ndarray) -> np.ndarray:
        return np.float32(0.25) * ((y > 0) & (y < 1))

    @staticmethod
    def cell(x: np.ndarray) -> np.ndarray:
        return np.clip(x, -1, 1)

    @staticmethod
    def cell_slope(y: np.ndarray) -> np.ndarray:
        return (np.abs(y) < 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(inputs: int, hidden: int, outputs: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    p: Params = {}
    for side in "fb":
        p[f"W{side}"] = (rng.standard_normal((inputs, 4 * hidden)) / np.sqrt(inputs)).astype(np.float32)
        p[f"U{side}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        p[f"b{side}"] = np.zeros(4 * hidden, np.float32)
        p[f"b{side}"][hidden : 2 * hidden] = 1
    p["V"] = (rng.standard_normal((2 * hidden, outputs)) / np.sqrt(2 * hidden)).astype(np.float32)
    p["c"] = np.zeros(outputs, np.float32)
    return p


def _run(p: Params, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None, kind: type = Soft) -> np.ndarray:
    """x: batch x steps x inputs; the state does not change where mask is 0."""
    batch, steps, _ = x.shape
    n = p[f"U{side}"].shape[0]
    h, c = np.zeros((batch, n), np.float32), np.zeros((batch, n), np.float32)
    out = np.zeros((batch, steps, n), np.float32)
    drive = x @ p[f"W{side}"] + p[f"b{side}"]
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = drive[:, t] + h @ p[f"U{side}"]
        gates, g = kind.gate(z[:, : 3 * n]), kind.cell(z[:, 3 * n :])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        new_c = f * c + i * g
        tc = kind.cell(new_c)
        m = mask[:, t : t + 1]
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * new_c + (1 - m) * c
        out[:, t] = h
    return out


def forward(p: Params, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Scores: batch x steps x outputs."""
    return np.concatenate([_run(p, s, x, mask, None) for s in "fb"], axis=2) @ p["V"] + p["c"]


def _back(p: Params, side: str, x: np.ndarray, kept: list, dout: np.ndarray, grad: Params, kind: type) -> None:
    n = p[f"U{side}"].shape[0]
    dh, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
    dz_all = np.zeros((*dout.shape[:2], 4 * n), np.float32)
    for t, h0, c0, i, f, o, g, tc, m in reversed(kept):
        dh = dh + dout[:, t]
        own, dcn = dh * m, dc * m
        dcn = dcn + own * o * kind.cell_slope(tc)
        dz = np.concatenate([dcn * g * kind.gate_slope(i), dcn * c0 * kind.gate_slope(f), own * tc * kind.gate_slope(o), dcn * i * kind.cell_slope(g)], axis=1)
        dz_all[:, t] = dz
        grad[f"U{side}"] += h0.T @ dz
        dh = dh * (1 - m) + dz @ p[f"U{side}"].T
        dc = dc * (1 - m) + dcn * f
    grad[f"b{side}"] += dz_all.sum((0, 1))
    grad[f"W{side}"] += np.tensordot(x, dz_all, ([0, 1], [0, 1]))


def gradients(p: Params, x: np.ndarray, mask: np.ndarray, loss, kind: type = Soft) -> tuple[float, Params]:
    """loss(scores) -> (value, derivative by the scores)."""
    kept: dict[str, list] = {"f": [], "b": []}
    h = np.concatenate([_run(p, s, x, mask, kept[s], kind) for s in "fb"], axis=2)
    value, ds = loss(h @ p["V"] + p["c"])
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["V"] += np.tensordot(h, ds, ([0, 1], [0, 1])).astype(np.float32)
    grad["c"] += ds.sum((0, 1)).astype(np.float32)
    dh, n = (ds @ p["V"].T).astype(np.float32), p["Uf"].shape[0]
    _back(p, "f", x, kept["f"], dh[:, :, :n], grad, kind)
    _back(p, "b", x, kept["b"], dh[:, :, n:], grad, kind)
    return value, grad


class Adam:
    def __init__(self, p: Params, rate: float = 0.01):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, grad: Params) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grad.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        for k, g in grad.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.p[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(self.p[k].dtype)
