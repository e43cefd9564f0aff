"""Whole-number arrays as small byte strings: differences, bytes of equal weight side by side, zstd."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<cBBQ")


def squeeze(x: np.ndarray, delta: bool = False) -> bytes:
    """``delta`` suits sorted arrays; differences wrap around, so any array survives it."""
    x = np.ascontiguousarray(x).ravel()
    y = x.view(np.dtype(f"u{x.itemsize}"))
    if delta and len(y):
        y = np.concatenate([y[:1], y[1:] - y[:-1]])
    planes = np.ascontiguousarray(y.view(np.uint8).reshape(len(y), x.itemsize).T)
    head = _HEAD.pack(x.dtype.kind.encode(), x.itemsize, delta, len(x))
    return head + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True) if len(x) else head


def expand(blob: bytes) -> np.ndarray:
    kind, size, delta, n = _HEAD.unpack_from(blob)
    if not n:
        return np.zeros(0, np.dtype(f"{kind.decode()}{size}"))
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[_HEAD.size :], n * size, asbytes=True), np.uint8)
    y = np.ascontiguousarray(planes.reshape(size, n).T).view(np.dtype(f"u{size}")).ravel()
    if delta:
        y = np.cumsum(y, dtype=y.dtype)
    return y.view(np.dtype(f"{kind.decode()}{size}"))
