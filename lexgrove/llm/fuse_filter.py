"""Static binary-fuse filters (three hashes, 8-bit fingerprints) in numpy.

Built from the published description of binary fuse filters. A filter never
misses a key it was built from; other keys pass about once in 256 times. A
serialised filter is ``seed, segment length, number of segments`` as little-endian
unsigned 64-bit numbers, followed by one byte per slot.
"""

from __future__ import annotations

import numpy as np

_HEADER = 24


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser (murmur) of keys plus seed."""
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _slots(hashed: np.ndarray, length: int, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One slot in each of three consecutive segments."""
    start = ((hashed >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    first = start.astype(np.int64) * length
    mask = np.uint64(length - 1)
    a = first + (hashed & mask).astype(np.int64)
    b = first + length + ((hashed >> np.uint64(18)) & mask).astype(np.int64)
    c = first + 2 * length + ((hashed >> np.uint64(9) ^ hashed >> np.uint64(40)) & mask).astype(np.int64)
    return a, b, c


def _prints(hashed: np.ndarray) -> np.ndarray:
    return ((hashed ^ (hashed >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """Filter over distinct-ified unsigned 64-bit keys; deterministic."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    length = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))) if n > 1 else 2.0
    segments = max(1, -(-int(n * factor) // length) - 2)
    for seed in range(1, 200):
        if seed % 20 == 0:
            segments += 1 + segments // 8
        hashed = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        table = _peel(hashed, length, segments)
        if table is not None:
            return np.array([seed, length, segments], "<u8").tobytes() + table.tobytes()
    raise RuntimeError(f"no binary-fuse filter found for {n} keys")


def _peel(hashed: np.ndarray, length: int, segments: int) -> np.ndarray | None:
    n, size = len(hashed), (segments + 2) * length
    slots = np.stack(_slots(hashed, length, segments), axis=1)
    count = np.bincount(slots.ravel(), minlength=size)
    total = np.bincount(slots.ravel(), np.repeat(np.arange(n, dtype=np.float64), 3), minlength=size).astype(np.int64)
    order: list[tuple[np.ndarray, np.ndarray]] = []
    single, left = np.flatnonzero(count == 1), n
    while len(single):
        key, at = np.unique(total[single], return_index=True)
        slot = single[at]
        order.append((key, slot))
        left -= len(key)
        touched = slots[key].ravel()
        np.subtract.at(count, touched, 1)
        np.subtract.at(total, touched, np.repeat(key, 3))
        touched = np.unique(touched)
        single = touched[count[touched] == 1]
    if left:
        return None
    table = np.zeros(size, np.uint8)
    prints = _prints(hashed)
    for key, slot in reversed(order):  # keys peeled together don't use each other's slots
        table[slot] = 0
        a, b, c = slots[key].T
        table[slot] = prints[key] ^ table[a] ^ table[b] ^ table[c]
    return table


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key whether it may be in the filter."""
    seed, length, segments = np.frombuffer(filter_bytes, "<u8", 3).tolist()
    table = np.frombuffer(filter_bytes, np.uint8, offset=_HEADER)
    hashed = _mix(np.asarray(keys, np.uint64), seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    a, b, c = _slots(hashed, int(length), int(segments))
    return (table[a] ^ table[b] ^ table[c]) == _prints(hashed)
