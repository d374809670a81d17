"""Number arrays as compact binary values, for exchanges between batches and shards."""

from __future__ import annotations

import pickle

import numpy as np


def packed(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpacked(data: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def gaps(values: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences; ``np.cumsum`` gives them back."""
    return narrow(np.diff(values, prepend=0))


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
