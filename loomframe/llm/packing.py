"""Arrays as compressed blobs, so that a shuffle moves a few large rows instead of one row per item."""

from __future__ import annotations

import pickle

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays go in as byte planes, which compress better."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if a.itemsize > 1 and len(a) else a.view(np.uint8)
        parts.append((a.dtype.str, len(a), planes.tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, 5))


def unpack(blob: bytes) -> list[np.ndarray]:
    out = []
    for kind, n, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)):
        dtype = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8)
        if dtype.itemsize > 1 and n:
            planes = np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).ravel()
        out.append(planes.view(dtype))
    return out


def smallest(a: np.ndarray) -> np.ndarray:
    """The same values, not negative, in the narrowest unsigned type."""
    top = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
