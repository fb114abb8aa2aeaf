"""Vectorised 64-bit hashes of byte ranges."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}
#: The tables of powers that a worker keeps; longer texts make their own and let go of them.
_KEPT = (1 << 20) + 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if n <= _KEPT and _POWERS:
        return _POWERS["up"], _POWERS["down"]
    made = {}
    for name, base in (("up", BASE), ("down", np.uint64(pow(int(BASE), -1, 1 << 64)))):
        steps = np.full(max(n, _KEPT), base, np.uint64)
        steps[0] = 1
        made[name] = np.cumprod(steps, dtype=np.uint64)
    if n <= _KEPT:
        _POWERS.update(made)
    return made["up"], made["down"]


class Prefixes:
    """Prefix sums of a polynomial hash; the hash of any range of bytes follows from two of them."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self.total[1:])

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[begin]) * self.down[begin] + (end - begin).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every range of this size."""
        n = max(0, len(self.total) - size)
        return mixed((self.total[size:] - self.total[:n]) * self.down[:n])
