"""A bidirectional gated recurrent network over bytes, in numpy: training by backpropagation through time, and inference.

Both directions run side by side in one array: axis 1 of the states is the direction, and the second direction reads the bytes backwards."""

from __future__ import annotations

import numpy as np

from ..functions.ship import by_value

Weights = dict[str, np.ndarray]


def init(hidden: int, classes: int, seed: int) -> Weights:
    """x: a row per gate, direction and byte; h: states to gates; c: bias of the gates; o, d: output. Gates are update, reset, new."""
    rng = np.random.default_rng(seed)
    p = {
        "x": rng.normal(0, 0.1, (3, 2, 256, hidden)),
        "h": rng.normal(0, 1 / np.sqrt(hidden), (3, 2, hidden, hidden)),
        "c": np.zeros((3, 2, 1, hidden)),
        "o": rng.normal(0, 1 / np.sqrt(2 * hidden), (2, hidden, classes)),
        "d": np.zeros(classes),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def _places(x: np.ndarray) -> np.ndarray:
    """Rows of the byte table that each step reads, (time, gate, direction, batch)."""
    both = np.stack([x.astype(np.int64), x[::-1].astype(np.int64) + 256], 1)
    return both[:, None] + np.arange(3)[:, None, None] * 512


def states(p: Weights, x: np.ndarray, keep: bool = False):
    """States (time + 1, direction, batch, hidden) over byte columns x (time, batch); with keep also the gates that the way back needs.

    Gates come first in the arrays, so that each is contiguous."""
    T, B = x.shape
    H = p["h"].shape[-1]
    dtype = p["h"].dtype
    half = np.array([0.5, 0.5, 1.0], dtype)[:, None, None, None]  # a logistic function is a tanh of half the argument
    table, wh = ((p["x"] + p["c"]) * half).reshape(1536, H), p["h"] * half
    at = _places(x)
    hs = np.zeros((T + 1, 2, B, H), dtype)
    gates, new, drive = (np.empty((T, *k, 2, B, H), dtype) if keep else None for k in ((2,), (), ()))
    g, a = np.empty((3, 2, B, H), dtype), np.empty((3, 2, B, H), dtype)
    for t in range(T):
        h = hs[t]
        np.take(table, at[t], axis=0, out=g, mode="clip")
        np.matmul(h, wh, out=a)
        s, u, n = g[:2], a[2], g[2]
        s += a[:2]
        np.tanh(s, out=s)
        s += 1
        s *= 0.5
        if keep:
            gates[t], drive[t] = s, u
        u *= s[1]
        n += u
        np.tanh(n, out=n)
        if keep:
            new[t] = n
        d = np.subtract(h, n, out=hs[t + 1])
        d *= s[0]
        d += n
    return hs, gates, new, drive


def _scores(p: Weights, hs: np.ndarray) -> np.ndarray:
    """Class probabilities (time, batch, class) from the states of both directions."""
    s = hs[1:, 0] @ p["o"][0]
    s += (hs[1:, 1] @ p["o"][1])[::-1]
    s += p["d"]
    s -= s.max(-1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(-1, keepdims=True)
    return s


def probabilities(p: Weights, x: np.ndarray) -> np.ndarray:
    """(time, batch, class) from byte columns x (time, batch)."""
    return _scores(p, states(p, x)[0])


def gradients(p: Weights, x: np.ndarray, y: np.ndarray) -> tuple[float, Weights]:
    """Mean loss over the positions and its gradients. y holds a class per position (time, batch), -1 without loss, or
    target probabilities (time, batch, class), all zero without loss."""
    hs, gates, new, drive = states(p, x, True)
    T, B = x.shape
    H = hs.shape[3]
    q = _scores(p, hs)
    if y.ndim == 2:
        y = (y[..., None] == np.arange(q.shape[-1])).astype(q.dtype)
    on = y.sum(-1, keepdims=True)
    total = max(1.0, float(on.sum()))
    loss = float(-(y * np.log(np.maximum(q, 1e-9))).sum() / total)
    ds = (q * on - y) / q.dtype.type(total)
    both = np.stack([ds, ds[::-1]], 1)
    grad = {"d": ds.sum((0, 1)), "o": np.stack([np.tensordot(hs[1:, k], both[:, k], ((0, 1), (0, 1))) for k in (0, 1)])}
    dout = np.matmul(both, p["o"].transpose(0, 2, 1))
    dg, da = np.empty((T, 3, 2, B, H), q.dtype), np.empty((T, 3, 2, B, H), q.dtype)
    back = np.ascontiguousarray(p["h"].transpose(0, 1, 3, 2))
    dh = np.zeros((2, B, H), q.dtype)
    for t in range(T - 1, -1, -1):
        dh += dout[t]
        (z, r), n = gates[t], new[t]
        (dz, dr, dn), a = dg[t], da[t]
        np.subtract(hs[t], n, out=dz)
        dz *= dh
        dz *= z * (1 - z)
        np.multiply(dh, 1 - z, out=dn)
        dn *= 1 - n * n
        np.multiply(dn, drive[t], out=dr)
        dr *= r * (1 - r)
        a[:2] = dg[t, :2]
        np.multiply(dn, r, out=a[2])
        dh *= z
        dh += np.matmul(a, back).sum(0)
    before = np.ascontiguousarray(hs[:-1].transpose(1, 3, 0, 2)).reshape(2, H, T * B)
    grad["h"] = np.matmul(before, np.ascontiguousarray(da.transpose(1, 2, 0, 3, 4)).reshape(3, 2, T * B, H))
    used, at = np.unique(x, return_inverse=True)
    hot = np.zeros((len(used), T * B), q.dtype)
    hot[at.reshape(-1), np.arange(T * B)] = 1
    flipped = np.ascontiguousarray(hot.reshape(-1, T, B)[:, ::-1]).reshape(-1, T * B)
    grad["x"] = np.zeros_like(p["x"])
    grad["x"][:, :, used] = np.matmul(np.stack([hot, flipped]), np.ascontiguousarray(dg.transpose(1, 2, 0, 3, 4)).reshape(3, 2, T * B, H))
    grad["c"] = grad["x"].sum(2, keepdims=True)
    return loss, grad


def train(p: Weights, batches, rate: float = 0.01, last: float = 0.1) -> tuple[Weights, list[float]]:
    """Adam over (x, y) batches as gradients() takes them. The rate falls to the share `last` of it over the batches."""
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    losses = []
    for step, (x, y) in enumerate(batches, 1):
        loss, g = gradients(p, x, y)
        losses.append(loss)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        k = min(1.0, 1.0 / max(norm, 1e-9))
        lr = rate * (1 - (1 - last) * step / len(batches))
        for name, grad in g.items():
            grad = grad * k
            m[name] = 0.9 * m[name] + 0.1 * grad
            v[name] = 0.99 * v[name] + 0.01 * grad * grad
            p[name] = p[name] - (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-8)).astype(p[name].dtype)
    return p, losses


by_value(__name__)
