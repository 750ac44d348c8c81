"""A light gated recurrent layer in numpy, with backpropagation through time.

One gate a unit: z = sigmoid(az), c = tanh(ac), h' = h + z (c - h), where
[az, ac] = x + h U and x already holds the input's projection and the bias. Many
sequences ("lanes") run side by side.
"""

from __future__ import annotations

import math


def _gates(u):
    """The gate's and the candidate's half of u, each in rows of its own."""
    import numpy as np

    size = u.shape[0]
    return [np.array(w, dtype=np.float32, order="C") for w in (u[:, :size], u[:, size:])]


def _starts(keep, steps: int):
    """Lanes that begin a sequence at each step, None where there are none."""
    import numpy as np

    if keep is None:
        return [None] * steps
    at, lane = np.nonzero(keep == 0)
    cuts = np.searchsorted(at, np.arange(steps + 1)).tolist()
    return [lane[i:j] if i < j else None for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def forward_halves(z, c, u, h, keep=None, store: bool = False):
    """``forward`` with the input in two arrays of T x B x H, the gates' half
    multiplied by 1/2 and the candidates' half, which become the gates and the
    candidates: every step works on whole stretches of memory."""
    import numpy as np

    steps, lanes, size = z.shape
    uz, uc = _gates(u)
    uz *= 0.5  # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2
    out = np.empty((steps, lanes, size), dtype=np.float32)
    before = np.empty((steps, lanes, size), dtype=np.float32) if store else None
    part = np.empty((lanes, size), dtype=np.float32)
    for t, begin in enumerate(_starts(keep, steps)):
        if begin is not None:
            h = h.copy()
            h[begin] = 0
        for a, w in ((z[t], uz), (c[t], uc)):
            np.matmul(h, w, out=part)
            a += part
            np.tanh(a, out=a)
        gate, new = z[t], out[t]
        gate *= 0.5
        gate += 0.5
        np.subtract(c[t], h, out=new)
        new *= gate
        new += h
        if store:
            before[t] = h
        h = new
    return out, h.copy(), (before, z, c)


def backward_halves(grad, u, saved, keep=None):
    """Gradients (gates' half of x, not of its half; candidates' half; u) for grad,
    T x B x H, the loss's on the states."""
    import numpy as np

    steps, lanes, size = grad.shape
    before, z, c = saved
    back_z, back_c = (np.ascontiguousarray(w.T) for w in _gates(u))
    dz, dc = np.empty_like(z), np.empty_like(c)
    dh = np.zeros((lanes, size), dtype=np.float32)
    stay, part = np.empty_like(dh), np.empty_like(dh)
    starts = _starts(keep, steps)
    for t in range(steps - 1, -1, -1):
        dh += grad[t]
        np.subtract(1, z[t], out=stay)
        # a unit's own error on its way to the gate and to the candidate
        np.multiply(dh, z[t], out=part)
        np.subtract(c[t], before[t], out=dz[t])
        dz[t] *= stay
        dz[t] *= part
        np.multiply(c[t], c[t], out=dc[t])
        np.subtract(1, dc[t], out=dc[t])
        dc[t] *= part
        dh *= stay
        for d, w in ((dz[t], back_z), (dc[t], back_c)):
            np.matmul(d, w, out=part)
            dh += part
        if starts[t] is not None:
            dh[starts[t]] = 0
    rows = before.reshape(-1, size).T
    return dz, dc, np.concatenate([rows @ dz.reshape(-1, size), rows @ dc.reshape(-1, size)], axis=1)


def forward(x, u, h, keep=None, store: bool = False):
    """States of T steps for B lanes: x is T x B x 2H, h the state before.

    keep (T x B, 0 or 1) clears a lane's state before a step. Returns (states T x
    B x H, last state, what ``backward`` needs).
    """
    import numpy as np

    size = x.shape[2] // 2
    z, c = (np.array(half, dtype=np.float32, order="C") for half in (x[..., :size], x[..., size:]))
    z *= 0.5
    return forward_halves(z, c, u, h, keep, store)


def backward(grad, u, saved, keep=None):
    """Gradients (x, u) for grad, T x B x H, the loss's on the states."""
    import numpy as np

    dz, dc, du = backward_halves(grad, u, saved, keep)
    return np.concatenate([dz, dc], axis=2), du


def columns_input(x, pad: int):
    """Inputs by code (codes x 2H) as ``both_ways`` takes them: 2H x codes, the
    gates' half halved; at the code pad the gate is shut, so the state stays."""
    import numpy as np

    x = np.array(x.T, dtype=np.float32, order="C")
    size = len(x) // 2
    x[:size] *= 0.5
    x[:size, pad] = -1e4
    return x


def both_ways(inputs, u, codes):
    """States (T x H x B) of a layer from the left and of one from the right over the
    same codes, T x B. Lanes lie along the last axis, so every step works on whole
    rows; padding behind a lane's codes leaves the right layer at its zero state.
    """
    import numpy as np

    steps, lanes = codes.shape
    size = u[0].shape[0]
    turned = []
    for w in u:
        w = np.array(w.T, dtype=np.float32, order="C")
        w[:size] *= 0.5  # sigmoid(a) = tanh(a / 2) / 2 + 1 / 2
        turned.append(w)
    out = np.empty((2, steps, size, lanes), dtype=np.float32)
    h = [np.zeros((size, lanes), dtype=np.float32)] * 2
    a, x = np.empty((2, 2 * size, lanes), dtype=np.float32), np.empty((2, 2 * size, lanes), dtype=np.float32)
    for s in range(steps):
        for d, t in ((0, s), (1, steps - 1 - s)):
            np.take(inputs[d], codes[t], axis=1, out=x[d], mode="clip")
            np.matmul(turned[d], h[d], out=a[d])
        a += x
        np.tanh(a, out=a)
        z = a[:, :size]
        z *= 0.5
        z += 0.5
        for d, t in ((0, s), (1, steps - 1 - s)):
            new = out[d, t]
            np.subtract(a[d, size:], h[d], out=new)
            new *= z[d]
            new += h[d]
            h[d] = new
    return out


class Adam:
    """Adam over a dict of arrays, in place, with gradients clipped by norm. The
    arrays are taken in stretches that stay in the cache."""

    def __init__(self, params: dict, rate: float = 0.01, clip: float = 5.0, stretch: int = 1 << 14):
        import numpy as np

        self.params, self.rate, self.clip, self.n, self.stretch = params, rate, clip, 0, stretch
        self.m = {k: np.zeros_like(v, order="C") for k, v in params.items()}
        self.v = {k: np.zeros_like(v, order="C") for k, v in params.items()}

    def step(self, grads: dict, rate: float | None = None) -> None:
        import numpy as np

        self.n += 1
        flat = {k: np.ravel(g) for k, g in grads.items()}
        norm = math.sqrt(sum(float(np.dot(g, g)) for g in flat.values()))
        scale = min(1.0, self.clip / (norm + 1e-12))
        rate = (rate or self.rate) * math.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, all_g in flat.items():
            arrays = [x[k].reshape(-1) for x in (self.m, self.v, self.params)]
            for i in range(0, len(all_g), self.stretch):
                m, v, p = (x[i : i + self.stretch] for x in arrays)
                g = all_g[i : i + self.stretch] * scale
                m *= 0.9
                m += 0.1 * g
                g *= g
                g *= 0.001
                v *= 0.999
                v += g
                np.sqrt(v, out=g)
                g += 1e-8
                np.divide(m, g, out=g)
                g *= rate
                p -= g


def softmax(a):
    import numpy as np

    a = a - a.max(axis=-1, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=-1, keepdims=True)
    return a


def scatter_rows(index, values, rows: int):
    """Sums of the rows of values by index (flat), as rows x width."""
    import numpy as np

    order = np.argsort(index, kind="stable")
    index = index[order]
    out = np.zeros((rows, values.shape[1]), dtype=np.float32)
    if len(index):
        first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        out[index[first]] = np.add.reduceat(values[order], first, axis=0)
    return out
