"""Causal linear filters on one block of rows, as matrix products over short sub-blocks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

STEP = 64


class CausalFilter:
    """Difference equation b, a in state form: s' = A s + B x, y = s[0] + b[0] x.

    Whole sub-blocks of STEP rows are two matrix products; only one small state
    update per sub-block stays in Python.
    """

    def __init__(self, b: Sequence[float], a: Sequence[float]) -> None:
        b, a = np.asarray(b, float), np.asarray(a, float)
        order = len(a) - 1
        self.direct = b[0]
        self.turn = np.zeros((order, order))
        self.turn[:, 0] = -a[1:]
        self.turn[:-1, 1:] = np.eye(order - 1)
        self.drive = b[1:] - a[1:] * b[0]
        powers = [np.eye(order)]
        for _ in range(STEP):
            powers.append(self.turn @ powers[-1])
        impulse = np.array([self.direct] + [(powers[k] @ self.drive)[0] for k in range(STEP - 1)])
        rows, cols = np.indices((STEP, STEP))
        self.response = np.where(rows >= cols, impulse[rows - cols], 0.0)
        self.observe = np.stack([powers[k][0] for k in range(STEP)])
        self.reach = np.stack([powers[STEP - 1 - k] @ self.drive for k in range(STEP)], axis=1)
        self.leap = powers[STEP]

    def rest(self) -> np.ndarray:
        return np.zeros(len(self.drive))

    def steady(self) -> np.ndarray:
        """State after a constant input of one."""
        return np.linalg.solve(np.eye(len(self.drive)) - self.turn, self.drive)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output of ``x`` from ``state``, and the state after the last row."""
        s = np.asarray(state, float)
        whole = len(x) // STEP * STEP
        y = np.empty(len(x))
        if whole:
            parts = np.asarray(x[:whole], float).reshape(-1, STEP)
            gained = parts @ self.reach.T
            states = np.empty((len(parts), len(s)))
            for i, g in enumerate(gained):
                states[i] = s
                s = self.leap @ s + g
            y[:whole] = (parts @ self.response.T + states @ self.observe.T).reshape(-1)
        for i in range(whole, len(x)):
            y[i] = s[0] + self.direct * x[i]
            s = self.turn @ s + self.drive * x[i]
        return y, s


def lowpass(cutoff_hz: float, sample_hz: float) -> CausalFilter | None:
    """Second-order Butterworth low-pass by the bilinear transform; None at or above Nyquist."""
    if cutoff_hz >= sample_hz / 2:
        return None
    k = math.tan(math.pi * cutoff_hz / sample_hz)
    norm = 1 + math.sqrt(2) * k + k * k
    return CausalFilter([k * k / norm, 2 * k * k / norm, k * k / norm],
                        [1.0, 2 * (k * k - 1) / norm, (1 - math.sqrt(2) * k + k * k) / norm])
