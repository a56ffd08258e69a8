"""Small recurrent networks in numpy: a bidirectional GRU with attention pooling, a bidirectional LSTM, and Adam."""

from __future__ import annotations

import numpy as np

F4 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


class Adam:
    def __init__(self, params: dict, rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            self.params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)).astype(F4)


def _uniform(rng, *shape):
    return (rng.uniform(-1, 1, shape) / np.sqrt(shape[0])).astype(F4)


class GRUAttention:
    """Reads X (steps x sequences x inputs) both ways, pools the states by attention.

    ``project`` is the input half of every gate, which callers can compute once for each distinct input; ``run`` is the rest.
    """

    def __init__(self, inputs: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p |= {f"W{d}": _uniform(rng, inputs, 3 * hidden), f"b{d}": np.zeros(3 * hidden, F4), f"U{d}": _uniform(rng, hidden, 3 * hidden)}
        self.p |= {"A": _uniform(rng, 2 * hidden, hidden), "a": _uniform(rng, hidden)}

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]], axis=-1).astype(F4)

    def states(self, projected: np.ndarray, mask: np.ndarray, saved: list | None = None) -> np.ndarray:
        """projected: steps x sequences x 6 hidden; mask: steps x sequences. The states, steps x sequences x 2 hidden."""
        t, n, h = len(projected), projected.shape[1], self.h
        states = np.zeros((t, n, 2 * h), F4)
        full = mask.all(1)
        for k, d in enumerate("fb"):
            state, own, u = np.zeros((n, h), F4), projected[:, :, 3 * h * k : 3 * h * (k + 1)], self.p[f"U{d}"]
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                hu = state @ u
                gates = sigmoid(own[i, :, : 2 * h] + hu[:, : 2 * h])
                z, r = gates[:, :h], gates[:, h:]
                new = np.tanh(own[i, :, 2 * h :] + r * hu[:, 2 * h :])
                m = mask[i][:, None]
                after = new + z * (state - new)
                if not full[i]:
                    after = np.where(m > 0, after, state)
                if saved is not None:
                    saved.append((k, i, state, z, r, new, hu[:, 2 * h :], m))
                state = states[i, :, h * k : h * (k + 1)] = after
        return states

    def attention(self, states: np.ndarray) -> np.ndarray:
        """How much each state counts where states are pooled, before the softmax."""
        return np.tanh(states @ self.p["A"]) @ self.p["a"]

    def run(self, projected: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """The pooled states, sequences x 2 hidden, of what ``states`` takes."""
        saved: list | None = None if keep is None else []
        states = self.states(projected, mask, saved)
        e = np.tanh(states @ self.p["A"])
        s = np.where(mask > 0, e @ self.p["a"], -1e9)
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * states).sum(0)
        if keep is not None:
            keep += [saved, states, e, w, pooled]
        return pooled

    def back(self, kept: list, d_pooled: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of U, A and a, and of what ``project`` gave."""
        saved, states, e, w, pooled = kept
        h = self.h
        dw = (states * d_pooled[None]).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        de = ds[:, :, None] * self.p["a"] * (1 - e**2)
        grads = {"a": (ds[:, :, None] * e).sum((0, 1)), "A": np.tensordot(states, de, ((0, 1), (0, 1)))}
        d_states = w[:, :, None] * d_pooled[None] + de @ self.p["A"].T
        d_proj = np.zeros((*states.shape[:2], 6 * h), F4)
        carry = {}
        for d in "fb":
            grads[f"U{d}"] = np.zeros_like(self.p[f"U{d}"])
        for k, i, before, z, r, new, hu, m in reversed(saved):
            d, part = "fb"[k], slice(h * k, h * (k + 1))
            g = d_states[i, :, part] + carry.get(k, 0)
            d_new = g * m * (1 - z) * (1 - new**2)
            d_z = -g * m * (new - before) * z * (1 - z)
            d_r = d_new * hu * r * (1 - r)
            d_in = np.concatenate([d_z, d_r, d_new], 1)
            d_hu = np.concatenate([d_z, d_r, d_new * r], 1)
            d_proj[i, :, 3 * h * k : 3 * h * (k + 1)] = d_in
            grads[f"U{d}"] += before.T @ d_hu
            carry[k] = g * (1 - m * (1 - z)) + d_hu @ self.p[f"U{d}"].T
        return grads, d_proj

    def back_project(self, x: np.ndarray, d_proj: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of W and b, and of the inputs (both with the leading axes flattened)."""
        h3 = 3 * self.h
        flat, d = x.reshape(-1, x.shape[-1]), d_proj.reshape(-1, 2 * h3)
        grads = {"Wf": flat.T @ d[:, :h3], "Wb": flat.T @ d[:, h3:], "bf": d[:, :h3].sum(0), "bb": d[:, h3:].sum(0)}
        return grads, (d[:, :h3] @ self.p["Wf"].T + d[:, h3:] @ self.p["Wb"].T)


class BiLSTM:
    """Reads X (steps x sequences x inputs) both ways and gives a logit for each step."""

    def __init__(self, inputs: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {"v": _uniform(rng, 2 * hidden), "c": np.zeros(1, F4)}
        for d in "fb":
            self.p |= {f"W{d}": _uniform(rng, inputs, 4 * hidden), f"b{d}": np.zeros(4 * hidden, F4), f"U{d}": _uniform(rng, hidden, 4 * hidden)}
            self.p[f"b{d}"][hidden : 2 * hidden] = 1  # remember at first

    def run(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        t, n, h = len(x), x.shape[1], self.h
        states, saved = np.zeros((t, n, 2 * h), F4), []
        for k, d in enumerate("fb"):
            own, u = x @ self.p[f"W{d}"] + self.p[f"b{d}"], self.p[f"U{d}"]
            state, cell = np.zeros((n, h), F4), np.zeros((n, h), F4)
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                g = own[i] + state @ u
                gates = sigmoid(g[:, : 3 * h])
                new, m = np.tanh(g[:, 3 * h :]), mask[i][:, None]
                into, forget, out = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
                c = forget * cell + into * new
                tc = np.tanh(c)
                if keep is not None:
                    saved.append((k, i, state, cell, into, forget, out, new, tc, m))
                cell, state = cell + m * (c - cell), state + m * (out * tc - state)
                states[i, :, h * k : h * (k + 1)] = state
        if keep is not None:
            keep += [x, states, saved]
        return states @ self.p["v"] + self.p["c"]

    def back(self, kept: list, d_logit: np.ndarray) -> dict:
        x, states, saved = kept
        h = self.h
        grads = {"v": np.tensordot(states, d_logit, ((0, 1), (0, 1))), "c": d_logit.sum().reshape(1)}
        d_states = d_logit[:, :, None] * self.p["v"]
        d_own = {d: np.zeros((*states.shape[:2], 4 * h), F4) for d in "fb"}
        for d in "fb":
            grads[f"U{d}"] = np.zeros_like(self.p[f"U{d}"])
        carry: dict = {0: (0, 0), 1: (0, 0)}
        for k, i, state, cell, into, forget, out, new, tc, m in reversed(saved):
            d = "fb"[k]
            gs, gc = d_states[i, :, h * k : h * (k + 1)] + carry[k][0], carry[k][1]
            d_c = m * gc + m * gs * out * (1 - tc**2)
            g = np.concatenate([d_c * new * into * (1 - into), d_c * cell * forget * (1 - forget), m * gs * tc * out * (1 - out), d_c * into * (1 - new**2)], 1)
            d_own[d][i] = g
            grads[f"U{d}"] += state.T @ g
            carry[k] = ((1 - m) * gs + g @ self.p[f"U{d}"].T, (1 - m) * gc + d_c * forget)
        for d in "fb":
            flat = d_own[d].reshape(-1, 4 * h)
            grads[f"W{d}"] = x.reshape(-1, x.shape[-1]).T @ flat
            grads[f"b{d}"] = flat.sum(0)
        return grads
