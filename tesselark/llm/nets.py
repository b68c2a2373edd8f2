"""Small numpy networks: parameters, Adam, a gated recurrent layer and an LSTM."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Adam:
    """Adam on a dict of arrays, in place."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, clip: float = 5.0):
        self.p, self.rate, self.clip, self.t = params, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        shrink = min(1.0, self.clip / (norm + 1e-9))
        a = self.rate * scale * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * shrink
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.p[k] -= a * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def gru_forward(inputs: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States of a gated recurrent layer.

    ``inputs`` (steps, rows, 3h) are the input parts of the update, reset and
    candidate sums; ``u`` (h, 3h) the recurrent weights.
    """
    steps, rows, _ = inputs.shape
    h = u.shape[0]
    states, kept = np.zeros((steps + 1, rows, h), F32), []
    for t in range(steps):
        s = states[t]
        r = s @ u
        gates = inputs[t, :, : 2 * h] + r[:, : 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, reset = gates[:, :h], gates[:, h:]
        c = reset * r[:, 2 * h :]
        c += inputs[t, :, 2 * h :]
        np.tanh(c, out=c)
        n = states[t + 1]
        np.subtract(s, c, out=n)
        n *= z
        n += c
        if keep:
            kept.append((gates, r[:, 2 * h :].copy(), c))
    return states, kept


def gru_backward(d_states: np.ndarray, states: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the inputs, gradient of u) by backpropagation through time."""
    steps, rows, h = d_states.shape
    d_in = np.empty((steps, rows, 3 * h), F32)
    d_u = np.zeros_like(u)
    carry = np.zeros((rows, h), F32)
    for t in reversed(range(steps)):
        gates, rc, c = kept[t]
        z, reset = gates[:, :h], gates[:, h:]
        d = d_states[t] + carry
        s = states[t]
        dz = d * (s - c) * z * (1 - z)
        dc = d * (1 - z) * (1 - c * c)
        dr = dc * rc * reset * (1 - reset)
        d_in[t] = np.concatenate([dz, dr, dc], 1)
        back = np.concatenate([dz, dr, dc * reset], 1)
        d_u += s.T @ back
        carry = d * z + back @ u.T
    return d_in, d_u


def lstm_forward(inputs: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States of an LSTM (gates: in, forget, out, cell); where the mask is 0 the state stays."""
    steps, rows, _ = inputs.shape
    h = u.shape[0]
    states, cell, kept = np.zeros((steps + 1, rows, h), F32), np.zeros((rows, h), F32), []
    for t in range(steps):
        a = inputs[t] + states[t] @ u
        g = sigmoid(a[:, : 3 * h])
        c = np.tanh(a[:, 3 * h :])
        i, f, o = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :]
        m = mask[t, :, None]
        new = f * cell + i * c
        th = np.tanh(new)
        if keep:
            kept.append((i, f, o, c, cell, th, m))
        cell = m * new + (1 - m) * cell
        states[t + 1] = m * (o * th) + (1 - m) * states[t]
    return states, kept


def lstm_backward(d_states: np.ndarray, states: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the inputs, gradient of u)."""
    steps, rows, h = d_states.shape
    d_in, d_u = np.empty((steps, rows, 4 * h), F32), np.zeros_like(u)
    carry, d_cell = np.zeros((rows, h), F32), np.zeros((rows, h), F32)
    for t in reversed(range(steps)):
        i, f, o, c, before, th, m = kept[t]
        d = d_states[t] + carry
        dh = d * m
        do = dh * th * o * (1 - o)
        dn = dh * o * (1 - th * th) + d_cell * m
        a = np.concatenate([dn * c * i * (1 - i), dn * before * f * (1 - f), do, dn * i * (1 - c * c)], 1)
        d_in[t] = a
        d_u += states[t].T @ a
        carry = a @ u.T + d * (1 - m)
        d_cell = dn * f + d_cell * (1 - m)
    return d_in, d_u
