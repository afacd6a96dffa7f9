"""Static binary-fuse filters (three hashes, 16-bit fingerprints), built and probed with numpy.

A filter is a byte string: a header of four 8-byte integers (keys, seed, segment length, segments) and the slots.
Probing costs three reads; of keys that are not in it, one in 65,536 passes. All keys in it pass.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (the fixed multipliers of MurmurHash3)."""
    x = x + _U(seed)
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> _U(33))) * _U(m)
    return x ^ (x >> _U(33))


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of each hash: one in each of three segments that follow one another."""
    first = ((h >> _U(32)) * _U(segments)) >> _U(32)
    inner = [h & _U(length - 1), (h >> _U(18)) & _U(length - 1), _mix(h, 1) & _U(length - 1)]
    return np.stack([(first + _U(k)) * _U(length) + inner[k] for k in range(3)]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (_mix(h, 2) & _U(0xFFFF)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter for uint64 ``keys`` (repeats and none at all allowed)."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    length = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    grow = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, int(np.ceil(n * grow / length)) - 2)
    for seed in range(1, 200):
        if seed % 20 == 0:
            segments += 1 + segments // 10
        slots = _peeled(_mix(keys, seed), length, segments)
        if slots is not None:
            return np.array([n, seed, length, segments], dtype="<i8").tobytes() + slots.astype("<u2").tobytes()
    raise RuntimeError("no seed served")


def _peeled(h: np.ndarray, length: int, segments: int) -> np.ndarray | None:
    """Assign slots by peeling: rounds that take every key alone in a slot, then fill in the opposite order."""
    size = (segments + 2) * length
    at = _slots(h, length, segments)
    number = np.arange(len(h), dtype=np.int64)
    count = np.bincount(at.ravel(), minlength=size)
    mark = np.zeros(size, dtype=np.int64)
    for row in at:
        np.bitwise_xor.at(mark, row, number)
    rounds, left = [], len(h)
    alone = np.flatnonzero(count == 1)
    while left:
        if not len(alone):
            return None
        key, pick = np.unique(mark[alone], return_index=True)
        own = alone[pick]
        rounds.append((key, own))
        left -= len(key)
        for row in at[:, key]:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(mark, row, key)
        near = np.unique(at[:, key])
        alone = near[count[near] == 1]
    out = np.zeros(size, dtype=np.uint16)
    prints = _prints(h)
    for key, own in reversed(rounds):
        a, b, c = at[:, key]
        out[own] = 0
        out[own] = prints[key] ^ out[a] ^ out[b] ^ out[c]
    return out


def probe(data: bytes, keys: np.ndarray) -> np.ndarray:
    """Which ``keys`` may be in the filter; no key that is in it is missed."""
    n, seed, length, segments = np.frombuffer(data[:32], dtype="<i8").tolist()
    if not n:
        return np.zeros(len(keys), dtype=bool)
    slots = np.frombuffer(data[32:], dtype="<u2")
    h = _mix(keys.astype(np.uint64), seed)
    a, b, c = slots[_slots(h, length, segments)]
    return (a ^ b ^ c) == _prints(h)
