"""Recursive filters as linear systems whose state is taken from piece to piece."""

from __future__ import annotations

import numpy as np

from .dsp import BLOCK, _block_form


class Cascade:
    """Filter sections (b, a) in a row, as one linear system.

    A run's outputs and last state are those from rest and those of its first state
    without input, added. The latter state is a power of one matrix, so pieces of a
    signal can be run from rest side by side and be joined afterwards.
    """

    def __init__(self, sections):
        self.sections = []
        for b, a in sections:
            n = max(len(a), len(b))
            self.sections.append(([*map(float, b)] + [0.0] * (n - len(b)), [*map(float, a)] + [0.0] * (n - len(a))))
        self.cuts = np.cumsum([0, *(len(a) - 1 for _, a in self.sections)])
        self._powers: dict[int, np.ndarray] = {}

    @property
    def size(self) -> int:
        return int(self.cuts[-1])

    def rest(self) -> np.ndarray:
        return np.zeros(self.size)

    def steady(self, level: float) -> np.ndarray:
        """The state that a constant input leaves unchanged."""
        z = self.rest()
        for (b, a), lo in zip(self.sections, self.cuts):
            gain = sum(b) / sum(a)
            tail = 0.0
            for k in range(len(a) - 1, 0, -1):
                tail += b[k] - a[k] * gain
                z[lo + k - 1] = tail * level
            level *= gain
        return z

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outputs, last state) from state ``z``."""
        z = np.array(z, float)
        for (b, a), lo, hi in zip(self.sections, self.cuts, self.cuts[1:]):
            x, z[lo:hi] = _run(b, a, x, z[lo:hi])
        return x, z

    def moved(self, z: np.ndarray, n: int) -> np.ndarray:
        """The state after ``n`` samples of 0."""
        if n not in self._powers:
            step = np.stack([self.run(np.zeros(1), e)[1] for e in np.eye(self.size)], axis=1)
            self._powers[n] = np.linalg.matrix_power(step, n)
        return self._powers[n] @ z


def _run(b: list[float], a: list[float], x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One section, whole blocks by products and the rest sample by sample."""
    n, done, out = len(a) - 1, 0, []
    if len(x) >= BLOCK and np.abs((form := _block_form(tuple(b), tuple(a)))[3]).max() < 10:
        forced, free, pushed, moved = form
        done = len(x) // BLOCK * BLOCK
        blocks = x[:done].reshape(-1, BLOCK)
        gained, states = blocks @ pushed.T, np.empty((len(blocks), n))
        for k, own in enumerate(gained):
            states[k] = z
            z = moved @ z + own
        out.append((blocks @ forced.T + states @ free.T).ravel())
    state, rest = [*z.tolist(), 0.0], []
    for v in x[done:].tolist():
        w = b[0] * v + state[0]
        for k in range(1, n + 1):
            state[k - 1] = b[k] * v + state[k] - a[k] * w
        rest.append(w)
    out.append(np.array(rest, float))
    return np.concatenate(out), np.array(state[:n])
